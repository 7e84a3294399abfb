"""BPE encoding and decoding through a distinct-word table.

Words (between Unicode white space) are split in the scan, each distinct word of the
corpus is encoded once, ids return to the texts by position (see `wordtable`), and
decoding joins every id to its piece in the vocabulary's id-to-piece table, whose
size is the vocabulary's (49,408 rows), so each task holds it whole.

Splitting at white space first is exact for a tokenizer whose pre-tokenizer never
lets a token cross white space and whose normaliser works within words, as
``word_bpe_49k.json`` does: NFC never composes across white space.

Defined results: a null text is the empty text, which has no ids and decodes to "".
Repeated rows are encoded each; a null id is kept. Strings of special tokens in a
text are encoded as those tokens, as the library does by default.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameseek.llm import wordtable as wt
from frameseek.llm.common import parts_for, prepare, staged, total_chars

DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file is, on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, object] = {}


def _tokenizer(name: str):
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(name if os.sep in name else vocabulary_path(name))
        tok.no_truncation()
        tok.no_padding()
        _loaded[name] = tok
    return _loaded[name]


def _pieces(name: str) -> list[str]:
    key = f"{name}:pieces"
    if key not in _loaded:
        tok = _tokenizer(name)
        size = max(tok.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        _loaded[key] = [tok.id_to_token(i) or "" for i in range(size)]
    return _loaded[key]


def encode_words(words: list[str], name: str) -> list[list[int]]:
    """Ids of each word, a thousand words to a library call."""
    tok, out = _tokenizer(name), []
    for at in range(0, len(words), 1000):
        some = words[at : at + 1000]
        enc = tok.encode(some, is_pretokenized=True, add_special_tokens=False)
        ids: list[list[int]] = [[] for _ in some]
        for word, i in zip(enc.word_ids, enc.ids):
            ids[word].append(i)
        out += ids
    return out


def _encode_part(name: str):
    def handle(bundles: list[tuple[int, list[bytes], np.ndarray]]) -> Iterator[tuple[int, None, bytes]]:
        known: dict[bytes, list[int]] = {}
        for _, words, _ in bundles:
            for w in words:
                known.setdefault(w, None)
        distinct = list(known)
        known = dict(zip(distinct, encode_words([w.decode() for w in distinct], name)))
        for block, words, _ in bundles:
            ids = [known[w] for w in words]
            lens = np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids))
            flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(lens.sum()))
            yield block, None, wt.pack((lens.astype(np.uint16) if len(lens) and lens.max() < 65536 else lens, flat.astype(np.uint16) if not len(flat) or flat.max() < 65536 else flat))

    return handle


def _finish(name: str, full: bool):
    def finish(block: wt.Block, answers: list[bytes]) -> pa.Table:
        got = [wt.unpack(a) for a in answers]
        none = np.empty(0, dtype=np.int64)
        lens = np.concatenate([g[0] for g in got] or [none]).astype(np.int64)
        flat = np.concatenate([g[1] for g in got] or [none]).astype("<u4")
        starts = np.concatenate(([0], np.cumsum(lens)))
        pieces = _pieces(name)
        words = [pieces[i] for i in flat.tolist()]
        slots = block.slots()
        text_of = [" ".join(words[a:b]) for a, b in zip(starts[:-1][slots].tolist(), starts[1:][slots].tolist())]
        lens, starts = lens[slots], starts[:-1][slots]
        silent = bool(len(lens)) and not lens.all()
        ids_out, text_out, n_out, at = [], [], [], 0
        for n in block.lens.tolist():
            codes = block.codes[at : at + n].astype(np.int64)
            at += n
            size = lens[codes]
            ends = np.cumsum(size)
            total = int(ends[-1]) if n else 0
            ids = flat[np.repeat(starts[codes] - ends + size, size) + np.arange(total)]
            some = [text_of[c] for c in codes.tolist()]
            text = " ".join([s for s, k in zip(some, size.tolist()) if k] if silent else some)
            n_out.append(total)
            ids_out.append(ids if full else hashlib.sha256(ids.tobytes()).hexdigest())
            text_out.append(text if full else hashlib.sha256(text.encode()).hexdigest())
        doc, n_tok, txt = pa.array(block.ids, pa.int64()), pa.array(n_out, pa.int64()), pa.array(text_out, pa.string())
        if full:
            return pa.table({"doc_id": doc, "n_tokens": n_tok, "ids": pa.array([i.astype(np.int32) for i in ids_out], pa.list_(pa.int32())), "decoded": txt})
        return pa.table({"doc_id": doc, "n_tokens": n_tok, "ids_sha256": pa.array(ids_out, pa.string()), "decoded_sha256": txt})

    return finish


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", full: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    ``full``: ids and decoded text as columns; else their digests (ids as little-endian
    unsigned 32-bit integers, the decoded text in UTF-8). ``vocabulary``: a file that the
    public tokenizers package has on every machine, or a path.
    """
    prepare(docs.sparkSession)
    parts = parts_for(total_chars(docs, text_col))
    blocks = staged(wt.build_blocks(docs, id_col, text_col, wt.split_unicode, parts), "bpe-blocks")
    resolved = wt.resolve(blocks, _encode_part(vocabulary), parts)
    return wt.assemble(blocks, resolved, _finish(vocabulary, full), FULL_SCHEMA if full else DIGEST_SCHEMA)
