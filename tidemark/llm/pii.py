"""Personal data: exact base patterns, and bootstrapped contextual extraction.

Base patterns give the seeds. Every mention of an identifier, seed or candidate,
has lexical patterns: the words before it, after it, and around it. Mentions and
patterns form a bipartite graph, scored in rounds on Spark: a pattern's confidence
is the score of its accepted instances and seeds over the number of all its distinct
instances (plus `caution`), an instance's score the noisy-or of its patterns; what
isn't accepted lends no pattern any weight, or doubtful ones would raise each other. A pattern is induced for a kind by
`least_seeds` distinct instances that are seeds or were accepted in an earlier round,
so what is found brings up further patterns. Candidates that reach `accept` for a kind
whose form they fit become spans beside the base ones, which stay as they are.

A pattern's words are those in the `CONTEXT` characters beside the mention. Every scan
is linear in the text, whatever it holds. Values of over 200 characters are told apart
by their SHA-256.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows
that repeat get the same spans, and copies of one identifier count once in a
pattern. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 3
CAUTION = 2.0
ACCEPT = 0.9
CONTEXT = 80  # characters on either side in which context words are looked for

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MAYBE_MAIL = re.compile(r"(?<![^\s@,;<>()\[\]])[^\s@,;<>()\[\]]++(?:@|\s?[(\[](?:at|AT)[)\]]\s?)[^\s@,;<>()\[\]]++")
_MAYBE_NUMBER = re.compile(r"[(+]?[0-9](?:[ ./()-]{0,2}[0-9]){6,}")

_MENTION = "struct<kind: string, start: int, end: int, seed: boolean, value: string, patterns: array<string>>"
_FOUND = f"doc_id long, rid long, mentions array<{_MENTION}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifier-like strings that no base span touches, once for each kind whose form they fit."""
    found = []
    if "@" in text or "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        found += [("email", *m.span()) for m in _MAYBE_MAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _MAYBE_NUMBER.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            dots = m[0].count(".")
            if 12 <= digits <= 19 and not dots:
                found.append(("card", *m.span()))
            if 7 <= digits <= 15 and dots != 3:
                found.append(("phone", *m.span()))
            if dots == 3 and digits <= 12:
                found.append(("ip", *m.span()))
    free, i = [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], x[2], x[0])):
        while i < len(base) and base[i][2] <= start:
            i += 1
        if i == len(base) or base[i][1] >= end:
            free.append((kind, start, end))
    return free


def context_patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a mention: two words before, one before and one after, two after."""
    left = text[max(0, start - CONTEXT) : start].lower().split()[-2:]
    right = text[end : end + CONTEXT].lower().split()[:2]
    left, right = ["^"] * (2 - len(left)) + left, right + ["$"] * (2 - len(right))
    return [f"{left[0]} {left[1]} _", f"{left[1]} _ {right[0]}", f"_ {right[0]} {right[1]}"]


def _value(text: str) -> str:
    return text if len(text) <= 200 else "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def _scan(frames):
    for pdf in frames:
        rows = []
        for text in pdf["text"]:
            base = base_spans(text)
            mine = []
            for is_seed, spans in ((True, base), (False, candidates(text, base))):
                for kind, s, e in spans:
                    mine.append({"kind": kind, "start": s, "end": e, "seed": is_seed, "value": _value(text[s:e]), "patterns": context_patterns(text, s, e)})
            rows.append(mine)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "rid": pdf["rid"], "mentions": rows})


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, rid and the mentions of every row."""
    docs = tx.documents(docs)
    return docs.withColumn("rid", tx.row_key(docs)).mapInPandas(_scan, _FOUND)


def bootstrap(found: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, caution: float = CAUTION, accept: float = ACCEPT) -> DataFrame:
    """(kind, value) of the candidates that the graph accepts, with their score."""
    one = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.value", "m.seed", "m.patterns")
    edges = one.select("kind", "value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))
    # a pattern with fewer instances than it takes to induce it never counts
    sizes = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n")).where(F.col("n") >= least_seeds)
    edges = tx.checkpoint(edges.join(sizes, "pattern"))
    scores = edges.groupBy("kind", "value").agg(F.max("seed").alias("seed"), F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        known = edges.join(scores.select("kind", "value", "score"), ["kind", "value"])
        induced = known.groupBy("pattern", "kind").agg(F.count_if(F.col("score") >= accept).alias("trusted"), (F.sum(F.when(F.col("score") >= accept, F.col("score"))) / (F.max("n") + caution)).alias("c")).where(F.col("trusted") >= least_seeds).select("pattern", "kind", "c")
        new = edges.join(induced, ["pattern", "kind"], "left").groupBy("kind", "value").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log1p(-F.least(F.coalesce("c", F.lit(0.0)), F.lit(0.999)))))).alias("score"))
        scores = tx.checkpoint(new.select("kind", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("score")).alias("score")))
    return scores.where(~F.col("seed") & (F.col("score") >= accept)).select("kind", "value", "score")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, rid, base and spans (arrays of start, rank, end, kind) of every row; spans holds base and what the graph found."""
    found = tx.checkpoint(mentions(docs))
    accepted = bootstrap(found)
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("m.kind"))
    each = found.where("exists(mentions, m -> not m.seed)").select("rid", F.explode("mentions").alias("m")).where("not m.seed")
    new = each.select("rid", F.col("m.kind").alias("kind"), F.col("m.value").alias("value"), F.struct(F.col("m.start").alias("start"), rank.alias("rank"), F.col("m.end").alias("end"), F.col("m.kind").alias("kind")).alias("span"))
    new = new.join(accepted.select("kind", "value"), ["kind", "value"]).groupBy("rid").agg(F.collect_set("span").alias("new"))
    order = "named_struct('start', m.start, 'rank', array_position(array('email', 'ip', 'card', 'phone'), m.kind) - 1, 'end', m.end, 'kind', m.kind)"
    base = F.expr(f"transform(filter(mentions, m -> m.seed), m -> {order})").cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    rows = found.select("doc_id", "rid", base.alias("base")).join(new, "rid", "left")
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("new").cast("array<struct<start: int, rank: int, end: int, kind: string>>"))))
    return rows.select("doc_id", "rid", "base", spans.alias("spans"))


def _written(name: str):
    return F.array_join(F.transform(name, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as a string, for every row."""
    counts = [F.expr(f"cast(size(filter(base, m -> m.kind = '{k}')) as bigint) as n_{k}") for k in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def mask(text: str, spans) -> str:
    """The text with each span, or union of overlapping ones, replaced by its kind in brackets."""
    out, done = [], 0
    for s in spans:
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with the found spans masked in text; n_chars, if there, follows."""
    key, spans = tx.private(docs, "row_key"), tx.private(docs, "found_spans")
    found = find(docs).where(F.size("spans") > 0).select(F.col("rid").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
    joined = docs.withColumn(key, tx.raw_key()).join(found, key, "left")

    @F.pandas_udf("string")
    def masked(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if f is None or t is None else mask(t, f) for t, f in zip(text, found)])

    out = joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(masked("text", spans)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop(key, spans)
