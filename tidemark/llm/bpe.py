"""BPE encoding and decoding with a public tokenizer file, by tree concatenation.

White space separates words for good, so a text's ids are those of its words in
order, and each distinct word of a block is encoded once. Words are unsplit text: the
pre-tokens of those over SPLIT characters are cut into pieces of that size, which are
encoded side by side, and neighbouring pieces are joined pairwise, as in a tree. At
each join a window of tokens is encoded again; it grows until its first and last token
equal those of the two sides. Pieces of runs of `long_run` characters or more are
larger and dealt out over tasks, so that no task holds the work of such a run alone.
Null texts count as empty; empty texts have no ids and decode to "".
Rows that repeat are encoded alike. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

SPLIT = 12
LONG_RUN = 2_000
MOST_KNOWN = 100_000  # words whose ids a worker remembers, some 22 MB; others are encoded anew
PIECE = 1_000  # characters of a piece that is dealt out


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def piece_models(path: str):
    """Encoders of a piece of one pre-token: inside it, and at its end."""
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    inner = Tokenizer(BPE(vocab=model["vocab"], merges=merges))
    last = Tokenizer(BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"] or ""))
    return inner, last, model["end_of_word_suffix"] or ""


def encode_piece(path: str, piece: str, is_last: bool) -> list[int]:
    inner, last, _ = piece_models(path)
    return (last if is_last else inner).encode(piece, add_special_tokens=False).ids if piece else []


def join_sides(path: str, left: list[int], right: list[int], is_last: bool) -> list[int]:
    """Ids of the joined text, from those of its two sides."""
    if not left or not right:
        return left or right
    _, _, suffix = piece_models(path)
    name = tokenizer(path).id_to_token
    n = 4
    while True:
        a, b = left[-n:], right[:n]
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        at_end = is_last and whole_right
        window = "".join(map(name, a)) + "".join(map(name, b))
        if at_end and suffix and window.endswith(suffix):
            window = window[: -len(suffix)]
        again = encode_piece(path, window, at_end)
        if (whole_left or again[0] == a[0]) and (whole_right or again[-1] == b[-1]):
            return left[: len(left) - len(a)] + again + right[len(b) :]
        n *= 2


@lru_cache(maxsize=2)
def added_tokens(path: str) -> list[str]:
    return sorted((x.content for x in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)


def pretokens(path: str, run: str) -> list[tuple[bool, str]]:
    """(is an added token, string) of a run: added tokens split it first, then the file's own rules."""
    t = tokenizer(path)
    parts: list[tuple[bool, str]] = [(False, run)]
    for a in added_tokens(path):
        if a not in run:
            continue
        split = []
        for is_added, s in parts:
            if is_added:
                split.append((True, s))
                continue
            for i, x in enumerate(s.split(a)):
                split += ([(True, a)] if i else []) + ([(False, x)] if x else [])
        parts = split
    out: list[tuple[bool, str]] = []
    for is_added, s in parts:
        if is_added:
            out.append((True, s))
        else:
            s = t.normalizer.normalize_str(s) if t.normalizer else s
            out += [(False, x) for x, _ in t.pre_tokenizer.pre_tokenize_str(s)]
    return out


def cut(path: str, run: str, size: int = PIECE) -> list[tuple[int, bool, bool, str]]:
    """Pieces of a long run: (pre-token, is last in it, is an added token, string)."""
    out = []
    for k, (is_added, s) in enumerate(pretokens(path, run)):
        starts = range(0, 1 if is_added else len(s), size)
        out += [(k, is_added or i + size >= len(s), is_added, s if is_added else s[i : i + size]) for i in starts]
    return out


def join_tree(path: str, pieces: list[tuple[list[int], bool]]) -> list[int]:
    """Joins (ids, is last) of one pre-token's pieces pairwise until one is left."""
    while len(pieces) > 1:
        pairs = zip(pieces[::2], pieces[1::2])
        pieces = [(join_sides(path, a, b, last), last) for (a, _), (b, last) in pairs] + pieces[len(pieces) // 2 * 2 :]
    return pieces[0][0] if pieces else []


def encode_unsplit(path: str, words: list[str], size: int = SPLIT) -> list[list[int]]:
    """Ids of words, by trees over pieces of at most size characters; all pieces are encoded first, in two batches."""
    t, (inner, last, _) = tokenizer(path), piece_models(path)
    plans = [cut(path, w, size) for w in words]
    batches: dict[bool, list[str]] = {False: [], True: []}
    for plan in plans:
        for _, is_last, is_added, s in plan:
            if not is_added:
                batches[is_last].append(s)
    ids = {k: iter(m.encode_batch_fast(batches[k], add_special_tokens=False)) for k, m in ((False, inner), (True, last))}
    out = []
    for plan in plans:
        own, pieces = [], []
        for _, is_last, is_added, s in plan:
            pieces.append(([t.token_to_id(s)] if is_added else next(ids[is_last]).ids, is_last))
            if is_last:
                own += join_tree(path, pieces)
                pieces = []
        out.append(own)
    return out


@lru_cache(maxsize=2)
def _known(path: str) -> dict[str, bytes]:
    """Ids of words that this worker has encoded."""
    return {}


def _encode_words(path: str, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t, known, step = tokenizer(path), _known(path), 20_000
    words = distinct.to_pylist()
    found = [known.get(w) for w in words]
    new = [i for i, x in enumerate(found) if x is None]
    plain, unsplit = [i for i in new if len(words[i]) <= SPLIT], [i for i in new if len(words[i]) > SPLIT]
    for at, encode in ((plain, lambda ws: [x.ids for x in t.encode_batch_fast(ws, add_special_tokens=False)]), (unsplit, lambda ws: encode_unsplit(path, ws))):
        for i in range(0, len(at), step):
            own = at[i : i + step]
            for k, ids in zip(own, encode([words[j] for j in own])):
                found[k] = array("I", ids).tobytes()
                if len(known) < MOST_KNOWN:
                    known[words[k]] = found[k]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return np.frombuffer(b"".join(found), np.uint32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of flat that codes name, one after the other, and where each starts."""
    sizes = np.diff(offsets)[codes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(int(ends[-1])) - np.repeat(ends[:-1] - offsets[codes], sizes)
    return flat[at], ends


def _names(path: str) -> pa.Array:
    t = tokenizer(path)
    size = t.get_vocab_size(with_added_tokens=True)
    return pa.array([t.id_to_token(i) or "" for i in range(size)])


def _encode_texts(path: str):
    """Encodes texts in which no run is long."""

    def run(batches):
        names = _names(path)
        for block in tx.blocks(batches, 8 << 20):
            flat, offsets = tx.words(tx.column(block, "text"))
            codes, distinct = tx.coded(flat)
            ids, starts = _encode_words(path, distinct)
            shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), names.take(pa.array(ids))), " ")
            full = np.diff(starts)[codes] > 0
            if not full.all():  # words without any token
                offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
                codes = codes[full]
            all_ids, ends = _gather(ids, starts, codes)
            cuts = ends[offsets]
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shown.take(pa.array(codes))), " ")
            arrow_ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(all_ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([tx.column(block, "doc_id"), arrow_ids, decoded], ["doc_id", "ids", "decoded"])

    return run


def _digest_texts(path: str):
    encode = _encode_texts(path)

    def run(batches):
        for b in encode(batches):
            ids = np.ascontiguousarray(np.asarray(b.column(1).values), dtype="<u4")
            cuts = np.asarray(b.column(1).offsets)
            where = np.frombuffer(b.column(2).buffers()[1], np.int32)[b.column(2).offset : b.column(2).offset + b.num_rows + 1]
            data = memoryview(b.column(2).buffers()[2] or b"")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.diff(cuts).astype(np.int64)),
                    pa.array([hashlib.sha256(ids[s:e].data).hexdigest() for s, e in zip(cuts[:-1], cuts[1:])]),
                    pa.array([hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(where[:-1], where[1:])]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _long_texts(docs: DataFrame, path: str, long_run: int) -> DataFrame:
    """(doc_id, ids) of the texts with long runs: pieces are dealt out, encoded, and joined by text."""

    def pieces(frames):
        import re

        for pdf in frames:
            rows = []
            for rid, doc_id, text in zip(pdf["rid"], pdf["doc_id"], pdf["text"]):
                at, short = 0, []
                for word in re.findall(r"[^\x20\x09-\x0D]+", text):
                    if len(word) < long_run:
                        short.append(word)
                        continue
                    if short:
                        rows.append((rid, doc_id, at, -1, 0, True, False, " ".join(short)))
                    at, short = at + 1, []
                    for i, (k, last, added, s) in enumerate(cut(path, word)):
                        rows.append((rid, doc_id, at, k, i, last, added, s))
                    at += 1
                if short:
                    rows.append((rid, doc_id, at, -1, 0, True, False, " ".join(short)))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["rid", "doc_id", "run", "pretoken", "piece", "is_last", "added", "s"])

    def encoded(frames):
        t = tokenizer(path)
        for pdf in frames:
            ids = []
            for k, last, added, s in zip(pdf["pretoken"], pdf["is_last"], pdf["added"], pdf["s"]):
                ids.append([t.token_to_id(s)] if added else t.encode(s, add_special_tokens=False).ids if k < 0 else encode_piece(path, s, last))
            yield pdf.assign(ids=ids)[["rid", "doc_id", "run", "pretoken", "piece", "is_last", "ids"]]

    def joined(pdf):
        import pandas as pd

        ids: list[int] = []
        pdf = pdf.sort_values(["run", "pretoken", "piece"], kind="stable")
        for _, g in pdf.groupby(["run", "pretoken"], sort=True):
            ids += join_tree(path, [(list(map(int, x)), bool(y)) for x, y in zip(g["ids"], g["is_last"])])
        return pd.DataFrame({"rid": [pdf["rid"].iloc[0]], "ids": [ids]})

    docs = docs.withColumn("rid", tx.row_key(docs))
    dealt = (
        docs.dropDuplicates(["rid"])
        .mapInPandas(pieces, "rid long, doc_id long, run int, pretoken int, piece int, is_last boolean, added boolean, s string")
        .repartition(tx.shuffle_width(docs.sparkSession), "rid", "run", "pretoken", "piece")
        .mapInPandas(encoded, "rid long, doc_id long, run int, pretoken int, piece int, is_last boolean, ids array<int>")
    )
    whole = dealt.groupBy("rid").applyInPandas(joined, "rid long, ids array<int>")
    return docs.select("rid", "doc_id").join(whole, "rid", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def _parts(docs: DataFrame, long_run: int) -> tuple[DataFrame, DataFrame]:
    docs = tx.documents(docs)
    is_long = F.col("text").rlike(f"[^\\x20\\x09-\\x0D]{{{long_run}}}")
    return docs.where(~is_long), docs.where(is_long)


def _decoded(path: str):
    def run(frames):
        t = tokenizer(path)
        for pdf in frames:
            yield pdf.assign(decoded=[t.decode(list(map(int, x)), skip_special_tokens=False) for x in pdf["ids"]])

    return run


def encode(docs: DataFrame, path: str, long_run: int = LONG_RUN) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row of docs."""
    plain, long = _parts(docs, long_run)
    out = "doc_id long, ids array<int>, decoded string"
    return plain.mapInArrow(_encode_texts(path), out).unionByName(_long_texts(long, path, long_run).mapInPandas(_decoded(path), out))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the string that the ids decode to (special tokens kept)."""
    rest = encoded.select("doc_id", "ids")
    return rest.mapInPandas(_decoded(path), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, long_run: int = LONG_RUN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    plain, long = _parts(docs, long_run)

    def digest(frames):
        for pdf in _decoded(path)(frames):
            yield pdf.assign(
                n_tokens=pdf["ids"].map(len),
                ids_sha256=[hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest() for x in pdf["ids"]],
                decoded_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in pdf["decoded"]],
            )[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return plain.mapInArrow(_digest_texts(path), out).unionByName(_long_texts(long, path, long_run).mapInPandas(digest, out))
