"""Secret scan: base patterns, and how many owners and repositories share each candidate.

Everything is DataFrame expressions. A scan of the whole text gives the base matches
and further candidates (tokens in the forms that providers give them, and long mixed
strings): a pattern's matches, and what lies between them, whose lengths add up to
offsets. The candidates' hashes are counted over the corpus, first once for each
repository, then once for each owner, so a value in a third of all rows is a few rows
by the time it is exchanged. A value of `wide_owners` owners or more, or of
`wide_repositories` repositories, is a widely copied example; one of a single owner is
that owner's, and looks live if it isn't written like a placeholder. What is found
outside of base matches, looks live and is an owner's own becomes a span beside them.

Base matches stay whatever the counts say; their verdicts are counted in n_live,
n_shared and n_example. Null and empty texts have no spans. Offsets are code points, ends
exclusive. Rows that repeat get the same spans and count once in a repository. Owners
and repositories that are null are one owner and one repository. An empty table
gives an empty result. Only doc_id, text and the columns of owner and repository are
read; those that are missing count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as tx

KINDS = ("assign", "access", "hex", "provider", "mixed")
BASE = KINDS[:3]
#: The base patterns, the group that holds the value, and the fewest characters of it.
#: Shorter runs of the second and third can't hold a match of their own, so their lengths are in the pattern.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    # public forms of providers' tokens, and signed web tokens
    "provider": r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "mixed": r"[A-Za-z0-9+/_-]{32,}",
}
LEAST = 6
WIDE_OWNERS, WIDE_REPOSITORIES = 5, 20
#: Parts of values that stand for a secret in documentation.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|change_me|your[_-]|redacted|insert|xxxx|test|todo|1234567|abcdef|0{6}|a{6}|f{6}|\.\.\."


def _matches(kind: str) -> Column:
    """Matches of a pattern in text: kind's place, gap (characters since the last match), size, whether it counts, value, and whether it is no placeholder."""
    pattern = F.lit(PATTERNS[kind])
    texts = F.regexp_extract_all("text", pattern, F.lit(0))
    values = F.regexp_extract_all("text", pattern, F.lit(2)) if kind == "assign" else texts

    def found(m):
        value = m["value"]
        match kind:
            case "assign":
                ok = F.length(value) >= LEAST
            case "mixed":
                ok = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
            case _:
                ok = F.lit(True)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["i"].alias("i"), F.length(m["gap"]).alias("gap"), F.length(m["text"]).alias("size"), ok.alias("ok"), F.unhex(F.md5(value)).alias("value"), (~value.rlike(PLACEHOLDER)).alias("plausible"))

    # the text is cut at its matches only where there are any
    gaps = F.split("text", PATTERNS[kind], -1)
    zipped = F.arrays_zip(texts.alias("text"), values.alias("value"), F.slice(gaps, 1, F.size(texts)).alias("gap"), F.sequence(F.lit(0), F.size(texts) - 1).alias("i"))
    return F.when(F.regexp_like("text", pattern), F.transform(zipped, found)).otherwise(F.array())


_FOUND = "array<struct<kind: int, i: int, gap: int, size: int, ok: boolean, value: binary, plausible: boolean>>"


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, rid, owner, repository and all matches of every row."""
    have = {c.lower() for c in docs.columns}

    def named(*columns):
        return F.to_json(F.struct(*[(F.col(c).cast("string") if c.lower() in have else F.lit(None).cast("string")).alias(f"c{k}") for k, c in enumerate(columns)]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), named(owner).alias("owner"), named(owner, *repository).alias("repository"))
    found = F.concat(*[_matches(k).cast(_FOUND) for k in KINDS])
    return rows.select("doc_id", tx.row_key(rows).alias("rid"), "owner", "repository", found.alias("found"))


def ownership(found: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """value, owners, repositories and class (`own`, `shared`, `example`) of every candidate."""
    one = found.select("owner", "repository", F.explode("found").alias("m")).where("m.ok").select(F.col("m.value").alias("value"), "owner", "repository").distinct()
    by_owner = one.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    counts = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    wide = (F.col("owners") >= wide_owners) | (F.col("repositories") >= wide_repositories)
    return counts.withColumn("class", F.when(wide, "example").when(F.col("owners") == 1, "own").otherwise("shared"))


def spans(found: DataFrame) -> DataFrame:
    """rid, kind, start, end, value, plausible and base of the matches that count, base ones and those that touch none."""
    row, order = Window.partitionBy("rid"), ("start", "kind")
    one = found.where(F.size("found") > 0).dropDuplicates(["rid"]).select("rid", F.explode("found").alias("m")).select("rid", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(row.partitionBy("rid", "kind").orderBy("i"))
    placed = one.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size")).where("ok")
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    # base matches come first, then what has a provider's form, then mixed strings;
    # both frames grow from one end, so a text's matches cost in proportion to their number
    for rank in (len(BASE), len(BASE) + 1):
        above = F.col("kind") < rank
        before = F.max(F.when(above, F.col("end"))).over(row.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        after = F.min(F.when(above, F.col("start"))).over(row.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = placed.withColumns({"before": before, "after": after}).where((F.col("kind") != rank) | free).drop("before", "after")
    return placed.select("rid", "kind", "start", "end", "value", "plausible", (F.col("kind") < len(BASE)).alias("base"))


def find(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), **wide) -> DataFrame:
    """doc_id, rid and found (array of start, kind, end, base, class, live) of every row."""
    scanned = tx.checkpoint(scan(docs, owner, repository))
    live = (F.col("class") == "own") & F.col("plausible")
    judged = spans(scanned).join(ownership(scanned, **wide).select("value", "class"), "value").withColumn("live", live).where("base or live")
    each = judged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base", "class", "live"))).alias("found"))
    return scanned.select("doc_id", "rid").join(each, "rid", "left")


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")


def digests(docs: DataFrame, **options) -> DataFrame:
    """Counts of the base spans by kind and by verdict, their digest, and all spans as a string, for every row."""
    rows = find(docs, **options).withColumn("found", F.coalesce("found", F.array()))
    base = F.filter("found", lambda m: m["base"])

    def count(test):
        return F.size(F.filter(base, test)).cast("long")

    def of(k):
        return count(lambda m: m["kind"] == k).alias(f"n_{BASE[k]}")

    kinds = [of(k) for k in range(len(BASE))]
    verdicts = [count(lambda m: m["live"]).alias("n_live"), count(lambda m: m["class"] == "shared").alias("n_shared"), count(lambda m: m["class"] == "example").alias("n_example")]
    return rows.select("doc_id", *kinds, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"), *verdicts)
