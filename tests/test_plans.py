"""Whole plans over small tables against brute force: nothing of a text, table or corpus is left out."""

from frameseek import catalog


def run(spark, tmp_path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]


DOCS = "doc_id long, text string, source string"
ITEMS = "item_id long, text string"
EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"


def test_containment_of_whole_passages_in_all_documents(spark, tmp_path):
    docs = [(1, "So the small red fox ran home", "src9"), (2, "on PHỞ bò is sold here", "src9"), (3, "the small red cat", "src1"), (4, "xx alpha yy", None), (5, None, "src0")]
    items = [(1, "small red fox ran"), (2, "pho bo is sold"), (3, "the small red dog"), (4, "alpha"), (5, "mall red c"), (6, "nowhere at all")]
    # Whole: items 1, 4 and 5; folded also 2; 3 and 6 nowhere.
    assert run(spark, tmp_path, "E19_answer_containment", documents=(docs, DOCS), benchmark=(items, ITEMS)) == [(6, 3, 4)]


def test_rare_tokens_up_to_200_documents_and_of_every_shape(spark, tmp_path):
    docs = [(i, f"common words {'zanzibar' if i < 150 else 'elsewhere'} {'x7 Ürünler' if i in (3, 4, 170) else 'plain'}", "a") for i in range(300)]
    docs += [(900, "prefixx7suffix zanzibars", "a"), (901, "", "a"), (902, None, "a")]
    items = [(1, "find zanzibar"), (2, "the X7, please"), (3, "common words"), (4, "Urunler zanzibar")]
    got = run(spark, tmp_path, "F8_rare_token_all", documents=(docs, DOCS), benchmark=(items, ITEMS))
    fold = {i: (t or "").lower().replace("ü", "u") for i, t, _ in docs}
    # 'common' is in 300 documents, 'please' in none.
    want = {1: ["zanzibar"], 2: ["x7"], 4: ["urunler", "zanzibar"]}
    assert sorted(got) == sorted((q, i) for q, need in want.items() for i, t in fold.items() if all(x in t for x in need))


def test_neighbours_of_every_row(spark, tmp_path):
    from datetime import datetime, timedelta

    events = [(i, i % 2, datetime(2024, 1, 1) + timedelta(seconds=i), "view", 1.0) for i in range(12)]
    got = run(spark, tmp_path, "W5_J1_neighbours", events=(events, "event_id long, user_id long, ts timestamp, event_type string, value double"))
    assert sorted(got) == [(a, b) for a in range(12) for b in range(12) if a % 2 == b % 2 and abs(a - b) <= 4]


def test_metadata_channel_reads_whole_pages(spark, tmp_path):
    pages = [(1, "http://a.b/c", "<p>" + "filler " * 100 + "needle</p>"), (2, "http://a.b/d", "<p>" + "filler " * 90 + "</p>")]
    got = run(spark, tmp_path, "T10_metadata_channel", pages=(pages, "page_id long, url string, html string"), benchmark=([(7, "needle")], ITEMS))
    assert [(q, p, r) for q, p, _, r in got] == [(7, 1, 1)]


def test_events_hold_the_whole_text(spark, tmp_path):
    text = "\n".join(f"line {i} of the text" for i in range(20))
    got = run(spark, tmp_path, "T16_event_split", benchmark=([(7, text)], ITEMS))
    flat = text.replace("\n", " ")
    assert sorted(got) == [(7, 0, flat[:40].strip()), (7, 1, flat[40:].strip())]


def test_window_around_purchases_against_pairs(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(3)
    begin = datetime(2024, 1, 1)
    events = [(i, rng.choice([1, 1, 1, 2, None]), begin + timedelta(minutes=rng.randrange(4000)), rng.choice(["view"] * 9 + ["purchase"]), 1.0) for i in range(300)]
    # Both ends of the range belong to it.
    events += [(900, 5, begin, "purchase", 1.0), (901, 5, begin + timedelta(hours=2), "view", 1.0), (902, 5, begin - timedelta(hours=1), "view", 1.0), (903, 5, begin + timedelta(hours=2, microseconds=1), "view", 1.0)]
    want = {b[0] for a in events for b in events if a[3] == "purchase" and a[1] is not None and a[1] == b[1] and timedelta(hours=-1) <= b[2] - a[2] <= timedelta(hours=2)}
    got = run(spark, tmp_path, "J9_asymmetric_window", events=(events, EVENTS))
    assert sorted(got) == sorted((i,) for i in want) and {900, 901, 902} <= want and 903 not in want


def test_frames_rise_strictly(spark, tmp_path):
    lines = [(1, 1, 5.0), (1, 2, 5.0), (1, 3, 3.0), (1, 4, 20.0), (2, 1, 9.0), (2, 1, 2.0)]
    got = run(spark, tmp_path, "K5_strictly_rising", lineitem=(lines, "l_orderkey long, l_linenumber int, l_quantity double"))
    assert sorted(got) == [(1, 1, 5), (1, 2, 6), (1, 3, 7), (1, 4, 20), (2, 1, 2), (2, 2, 9)]


def test_answers_are_cut_not_rewritten(spark, tmp_path):
    texts = ["  The And  The red fox.\nmore", "5 bowls of rice on a table", "5 bowls", "5a bowls of rice on a table", "words " * 40, "word " * 40, "y" * 150, "", None, "The The The The end"]
    got = run(spark, tmp_path, "T30_T31_answer_cleanup", documents=([(i, x, "s") for i, x in enumerate(texts)], DOCS))
    assert [a for _, a in sorted(got)] == ["red fox", "5", "5 bowls", "5a bowls of rice on a table", " ".join(["words"] * 16), " ".join(["word"] * 20), "y" * 100, "", "", "The end"]


def test_ranges_spread_to_frames(spark, tmp_path):
    texts = ["108-110, 123", "9-7 and 4", "none", None]
    got = run(spark, tmp_path, "T35_range_parsing", documents=([(i, x, "s") for i, x in enumerate(texts)], DOCS))
    assert sorted(got) == [(0, 0, 4, 108 + 109 + 110 + 123), (1, 1, 1, 4)]


def test_padding_skips_places_already_chosen(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    events = [(1, 1, at(0), "view", 95.0), (2, 1, at(30), "view", 1.0), (3, 1, at(90), "view", 1.0), (4, 2, at(30), "view", 1.0)]
    assert run(spark, tmp_path, "W19_pad_strided", events=(events, EVENTS)) == [(3, 1), (4, 2)]


def test_the_last_line_of_the_last_log_counts(spark, tmp_path):
    import json
    import os

    from frameseek.sources import files

    line = lambda k, v: json.dumps({"row_id": k, "caption": v}) + "\n"
    (tmp_path / "log").mkdir()
    # The file changed last is the first by name and the smallest, so neither name nor size orders it last.
    (tmp_path / "log" / "z").write_text("".join(line(i % 7, f"old{i}") for i in range(5000)))
    (tmp_path / "log" / "a").write_text(line(3, "new") + line(4, " ") + '{"row_id": 5, "ca')
    os.utime(tmp_path / "log" / "z", (1_700_000_000,) * 2)
    os.utime(tmp_path / "log" / "a", (1_700_000_100,) * 2)
    want = {i % 7: f"old{i}" for i in range(5000)} | {3: "new"}
    del want[4]  # its last line is blank
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert {r.row_id: r.caption for r in files.compact_log(spark, f"file://{tmp_path}/log", "row_id", "caption").collect()} == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nearest_rows_to_any_seed_against_pairs(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(5)
    events = [(i, rng.choice([1, 1, 2, None]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(200)), rng.choice(["view"] * 5 + ["purchase"]), 1.0) for i in range(80)]
    events += [(900, 7, datetime(2024, 1, 1), "view", 1.0)]
    want = []
    for video in (1, 2, 7):
        rows = [e for e in events if e[1] == video]
        near = sorted((min(abs(e[2] - s[2]) for s in rows if s[3] == "purchase"), e[0]) for e in rows if any(s[3] == "purchase" for s in rows))
        want += [(video, i, n) for n, (_, i) in enumerate(near[:5], 1)]
    assert sorted(run(spark, tmp_path, "W21_nearest_to_seed", events=(events, EVENTS))) == sorted(want) and len(want) == 10


def test_bad_records_are_kept_and_marked(spark, tmp_path):
    rows = [(1, '{"k": 5}'), (2, '{"k": 5'), (3, None), (4, '{"z": 1}'), (5, "no json")]
    got = run(spark, tmp_path, "S8_S10_json_props", events=(rows, "event_id long, props string"))
    assert sorted(got) == [(1, 5, False), (2, None, True), (3, None, False), (4, None, False), (5, None, True)]


def test_every_devset_rule_finds_its_row(spark, tmp_path):
    docs = [(1, "a fine text", "en", "s", 11), (2, " ", "en", "s", 1), (3, "x" * 10001, "en", "s", 10001), (4, "bonjour", "de", "s", 7), (5, "size", "fr", "s", 9)]
    docs += [(6, "same", "en", "s", 4), (7, "same", "en", "t", 4), (8, "one", "en", "s", 3), (8, "two", "en", "s", 3), (9, "bare", "en", "s", 4)]
    labels = [(i, 1) for i in range(1, 9)] + [(9, None), (99, 0)]
    got = run(spark, tmp_path, "E13_devset_rules", documents=(docs, "doc_id long, text string, lang string, source string, n_chars int"), labels=(labels, "doc_id long, quality int"))
    assert dict(got) == dict.fromkeys(["empty", "long", "language", "size", "copy", "sources", "twice", "no answer", "no document"], 1)


def test_gold_of_the_turn_before(spark, tmp_path):
    turns = [(1, 0, "u", "take Bo or Émil"), (1, 1, "u", "An Bo Émil Zed"), (1, 2, "u", "An Bo Cy Zed"), (1, 3, "u", None), (1, 4, "u", "Ed"), (2, 0, "u", "Émil")]
    got = run(spark, tmp_path, "E24_variant_oracle", conversations=(turns, "conv_id long, turn int, role string, text string"))
    assert sorted(got) == [(1, 1, "Émil", True), (1, 2, "Zed", False), (1, 3, "Zed", False)]


def test_answers_of_the_next_turn(spark, tmp_path):
    turns = [(1, 0, "u", "The and  of"), (1, 1, "u", " the  AND."), (1, 2, "u", "the and. more"), (1, 3, "u", None), (2, 0, "u", "Straße x"), (2, 1, "u", "Straße x y z"), (3, 0, "u", "a b"), (3, 1, "u", "a b")]
    got = run(spark, tmp_path, "E20_answer_match", conversations=(turns, "conv_id long, turn int, role string, text string"))
    # turn, pairs, equal, equal without case and signs, one inside the other, nothing after
    assert sorted(got) == [(0, 3, 1, 2, 3, 0), (1, 3, 0, 0, 1, 2), (2, 1, 0, 0, 0, 1), (3, 1, 1, 0, 0, 1)]
