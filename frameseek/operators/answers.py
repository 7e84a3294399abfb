"""Answers mined from a text for a question: numbers or names near the question's keywords.

Spans come with offsets from what stands between the matches. Keywords are sought in the folded
text, each for itself. Spans and keyword positions then lie in one table ordered by offset, where
the nearest keyword of a span is the last before or the first after it: two windows, no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameseek.functions import text as tx
from frameseek.operators.staging import staged

# What a number is, the letters of names, what asks for a number, and words that are no keywords.
NUMBER = r"\b\d{1,4}(?:[.,]\d+)?\s?(?:g|kg|ml|l|%)?\b"
UPPER = "A-ZĐÂÊÔƯĂÁÀÃẢẠÉÈẼẺẸÍÌĨỈỊÓÒÕỎỌÚÙŨỦỤÝỲỸỶỴ"
LOWER = "a-zàáâãèéêìíòóôõùúýăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
ASKS_NUMBER = r"\b(bao nhiêu|mấy|số|khối lượng|gam|kg|phần trăm|nhiệt độ|năm|giờ|độ|lít)\b"
NO_KEYWORD = "la gi cua o trong va co nao bao nhieu may mot hai ba cho nguoi duoc nhung khi tren duoi sau truoc".split()

#: One to three capitalised words; the wide form takes small ones behind the first.
NAME = rf"\b[{UPPER}][{LOWER}]+(?:\s+[{UPPER}][{LOWER}]+){{0,2}}\b"
WIDE_NAME = rf"\b[{UPPER}][{LOWER}]+(?:\s+[{UPPER}{LOWER}][{LOWER}]+){{0,2}}\b"
WHOLE_UNICODE, ANY_CASE = "(?U)", "(?iuU)"


def asks_number(question: Column) -> Column:
    return F.coalesce(question.rlike(ANY_CASE + ASKS_NUMBER), F.lit(False))


def _spans(texts: DataFrame, text: str, pattern: str) -> DataFrame:
    """(row, at, span): matches with the code points before them; ``texts``: row, ..."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(hits.alias("span"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    rows = texts.select("row", F.posexplode(zipped).alias("n", "x")).select("row", "n", "x.span", "x.gap")
    w = Window.partitionBy("row").orderBy("n")
    before = F.coalesce(F.sum(F.length("span")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("row", "span", (F.sum("gap").over(w) + before).cast("long").alias("at"))


def _keywords(texts: DataFrame) -> DataFrame:
    """(row, at): where each keyword of the question stands in the text, both folded."""
    words = F.array_distinct(F.filter(F.split("q", r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(NO_KEYWORD)))
    literal = lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    lengths = F.transform(words, lambda w: F.struct(F.length(w).alias("n"), F.transform(F.split(F.col("v"), literal(w), -1), F.length).alias("gaps")))
    rows = texts.select("row", F.posexplode(lengths).alias("word", "x")).where(F.size("x.gaps") > 1)
    rows = rows.select("row", "word", "x.n", F.posexplode(F.slice("x.gaps", F.lit(1), F.size("x.gaps") - 1)).alias("j", "gap"))
    w = Window.partitionBy("row", "word").orderBy("j")
    return rows.select("row", (F.sum("gap").over(w) + F.col("j") * F.col("n")).cast("long").alias("at"))


def _near(spans: DataFrame, keywords: DataFrame) -> DataFrame:
    """``spans`` with ``gap`` to the nearest keyword, null in a text without any."""
    both = spans.withColumn("key", F.lit(None).cast("long")).unionByName(keywords.select("row", "at", F.col("at").alias("key")), allowMissingColumns=True)
    before = F.last("key", ignorenulls=True).over(Window.partitionBy("row").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    after = F.last("key", ignorenulls=True).over(Window.partitionBy("row").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0))
    return both.select("*", F.least(F.col("at") - before, after - F.col("at")).alias("gap")).where("key is null").drop("key")


def candidates(pairs: DataFrame, wide: bool = False, number: Column | None = None) -> DataFrame:
    """(row, span, at, gap) that may answer, and the pairs with their row; ``pairs``: question, text, ..."""
    number = asks_number(F.col("question")) if number is None else number
    safe = pairs.withColumns({"row": F.monotonically_increasing_id(), "number": number, "v": tx.fold_marks(F.col("text")), "q": tx.fold_marks(F.col("question"))})
    safe = staged(safe)
    asked = safe.where("text is not null and question is not null")
    numbers = _spans(asked.where("number"), "text", ANY_CASE + NUMBER)
    names = _spans(asked.where("not number"), "text", WHOLE_UNICODE + (WIDE_NAME if wide else NAME))
    spans = numbers.withColumn("least", F.lit(0)).union(names.withColumn("least", F.lit(2)))
    spans = spans.withColumn("span", F.regexp_replace("span", r"^\s+|\s+$", "")).where(F.length("span") > F.col("least")).drop("least")
    spans = spans.join(asked.select("row", "q"), "row").where(~F.contains("q", tx.fold_marks(F.col("span")))).drop("q")
    return _near(spans, _keywords(asked)), safe


def _with_twins(found: DataFrame, order: list[str]) -> DataFrame:
    """``answer``: a span without accents becomes the first with accents that folds to the same, if there is one."""
    fold, marked = tx.fold_marks(F.col("span")), tx.has_diacritic(F.col("span"))
    found = found.withColumns({"fold": fold, "marked": marked})
    first = F.first(F.when(F.col("marked"), F.col("span")), ignorenulls=True).over(Window.partitionBy("row", "fold").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.withColumn("answer", F.when(F.col("marked"), F.col("span")).otherwise(F.coalesce(first, F.col("span"))))


def answer(pairs: DataFrame, wide: bool = False, number: Column | None = None) -> DataFrame:
    """``pairs`` (question, text, ...) with ``answer``: the span nearest to a keyword of the question, '' without any.

    A number where the question asks for one (``number`` overrides that), else a name; never what the question
    says itself. Without a keyword in the text the first span; of equally near spans the first.
    Null texts and questions have no answer. Repeated pairs are pairs each.
    """
    found, safe = candidates(pairs, wide, number)
    best = Window.partitionBy("row").orderBy(F.coalesce("gap", F.lit(0)), "at")
    one = _with_twins(found, ["at"]).withColumn("r", F.row_number().over(best)).where("r = 1").select("row", "answer")
    return safe.join(one, "row", "left").select(*pairs.columns, F.coalesce("answer", F.lit("")).alias("answer"))


def answers(pairs: DataFrame, k: int = 3, wide: bool = False, number: Column | None = None) -> DataFrame:
    """``pairs`` with ``rank`` and ``answer``: up to ``k`` answers as in ``answer``, different when folded, nearest first.

    ``wide`` names take small words after the first, and their parts of one to three words follow as answers after
    all whole ones. Pairs without an answer have no row.
    """
    found, safe = candidates(pairs, wide, number)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.coalesce("gap", F.lit(0)), "at"))
    found = found.select("row", "span", F.lit(0).alias("part"), place.alias("place"), F.lit(0).alias("n"), F.lit(0).alias("i"))
    if wide:
        words = F.split("span", r"\s+")
        pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(words))), lambda n: F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("span"), n.alias("n"), i.alias("i")))))
        cut = found.select("row", "place", F.explode(pieces).alias("x")).select("row", "x.span", F.lit(1).alias("part"), "place", "x.n", "x.i").where(F.length("span") > 2)
        cut = cut.join(safe.select("row", "q"), "row").where(~F.contains("q", tx.fold_marks(F.col("span")))).drop("q")
        found = found.unionByName(cut)
    order = ["part", "place", "n", "i"]
    found = _with_twins(found, order)
    found = found.withColumn("same", F.row_number().over(Window.partitionBy("row", "fold").orderBy(*order))).where("same = 1")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return safe.join(found.select("row", "rank", "answer"), "row").select(*pairs.columns, "rank", "answer")
