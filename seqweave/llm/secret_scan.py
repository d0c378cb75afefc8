"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found in every text; their hashes are counted by distinct repositories and distinct owners. A value
that many owners, or very many repositories of few owners, hold is a copied example; one that a single owner holds in
few repositories looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import whole_text
from seqweave.session import materialise

#: Pattern, group that is the secret, and its least length, by kind.
BASE_KINDS = (
    (
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]+)", 1, 16),
)
#: The method's own candidates: long runs that mix capitals, small letters and digits. They count only if one owner holds them.
MIXED_KIND = ("mixed", r"([A-Za-z0-9+/_-]+)", 1, 24)
_LEAST = {"assign": 1, "access": 18, "hex": 16, "mixed": 24}  # shorter runs need not be listed: see `_found`

COPIED, LIVE, SHARED = "copied", "live", "shared"
COPIED_REPOS = 100


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, order, end, kind, value) of one kind: pieces between the matches and the matches in turn give places.

    For a pattern that is one run of a character class, shorter runs cannot hide a longer one, so the least length
    goes into the pattern (a possessive run that starts at the run's first character).
    """
    n = _LEAST[kind]
    if kind == "access":
        pattern = rf"(AKIA[A-Z0-9]{{{n - 4},}})"
    elif kind in ("hex", "mixed"):
        inner = pattern[1:-2]
        pattern = rf"((?<!{inner}){inner}{{{n},}}+)"
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.split(text, pattern, -1)
    order = F.lit([k[0] for k in (*BASE_KINDS, MIXED_KIND)].index(kind))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gap, i))
        end = start + F.length(F.get(match, i))
        span = F.struct(
            start.cast("long").alias("start"), order.alias("order"), end.cast("long").alias("end"), F.lit(kind).alias("kind"), F.get(value, i).alias("value")
        )
        return F.struct(end.cast("long").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,value:string>>")
    walk = F.aggregate(
        F.sequence(F.lit(0), F.size(match) - 1),
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
        step,
        lambda acc: acc["spans"],
    )
    spans = F.filter(walk, lambda s: F.length(s["value"]) >= least)
    if kind == "mixed":
        spans = F.filter(spans, lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]"))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(id, repo, owner, base spans, mixed spans) per input row; mixed spans that touch a base span are left out."""
    text = whole_text(text_col)
    found = docs.select(
        F.col(id_col).alias("_id"),
        F.col(repo_col).cast("string").alias("_repo"),
        F.col(owner_col).cast("string").alias("_owner"),
        *[_found(text, *kind).alias(f"_{kind[0]}") for kind in (*BASE_KINDS, MIXED_KIND)],
    )
    base = F.array_sort(F.concat(*[F.col(f"_{k[0]}") for k in BASE_KINDS]))
    apart = F.filter("_mixed", lambda m: ~F.exists("_base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    return found.select("_id", "_repo", "_owner", base.alias("_base"), "_mixed").select("_id", "_repo", "_owner", "_base", apart.alias("_mixed"))


def ownership(found: DataFrame, copied_owners: int, copied_repos: int) -> DataFrame:
    """Per candidate hash: distinct repositories, distinct owners and status.

    (hash, owner, repository) is made distinct first, with a partial step before each shuffle, so a value that a
    third of all rows hold arrives as one row per task and the last counts see one row per owner or repository.
    """
    held = found.select("_repo", "_owner", F.explode(F.concat("_base", "_mixed")).alias("_s")).select(
        F.sha2("_s.value", 256).alias("_hash"), "_owner", "_repo"
    )
    once = held.groupBy("_hash", "_owner", "_repo").agg(F.lit(1).alias("_x"))
    owners = once.groupBy("_hash", "_owner").agg(F.lit(1).alias("_x")).groupBy("_hash").agg(F.count("_owner").alias("n_owners"))
    repos = once.groupBy("_hash", "_repo").agg(F.lit(1).alias("_x")).groupBy("_hash").agg(F.count("_repo").alias("n_repos"))
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    single = (F.col("n_owners") <= 1) & (F.col("n_repos") * 10 < copied_repos)
    return repos.join(owners, "_hash").withColumn("status", F.when(copied, COPIED).when(single, LIVE).otherwise(SHARED))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = 3, copied_repos: int = COPIED_REPOS
) -> DataFrame:
    """One row per input row: the id and `spans`, an array of (start, order, end, kind, value, n_repos, n_owners, status).

    Places are code points, end exclusive; spans are in the order of start, kind, end. All base spans are there;
    spans of kind `mixed` only where the value is `live`. status: `copied` from `copied_owners` distinct owners or
    `copied_repos` distinct repositories on, `live` for at most one owner and less than a tenth of those
    repositories, else `shared`. Null text has no spans; a null repository or owner is counted
    as none; repeated rows count once for ownership and are each returned; ids may be null or repeat. Other columns
    are ignored. What a text holds meets in one row, never what a value or an owner holds.
    """
    found = materialise(
        candidates(docs, id_col, text_col, repo_col, owner_col).withColumn("_row", F.monotonically_increasing_id())
    )
    owned = ownership(found, copied_owners, copied_repos)
    rows = found.select("_row", F.explode(F.concat("_base", "_mixed")).alias("_s")).withColumn("_hash", F.sha2("_s.value", 256))
    judged = rows.join(owned, "_hash").filter((F.col("_s.kind") != MIXED_KIND[0]) | (F.col("status") == LIVE))
    span = F.struct("_s.start", "_s.order", "_s.end", "_s.kind", "_s.value", "n_repos", "n_owners", "status")
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return found.select("_row", "_id").join(spans, "_row", "left").select(F.col("_id").alias(id_col), F.coalesce("spans", empty).alias("spans"))


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = 3, copied_repos: int = COPIED_REPOS, mask: str = "[secret]"
) -> DataFrame:
    """`docs` with the spans that are not widely copied examples replaced by `mask`, all rows and columns as they are.

    Overlapping spans are masked as one. Texts without such spans stay as they are, null stays null, rows that
    repeat and rows without an id are masked each by their own text.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("text"))
    rows = docs.select(key.alias("_key"), whole_text(text_col).alias("_text"), F.col(repo_col).alias("_repo"), F.col(owner_col).alias("_owner"))
    hot = F.filter("spans", lambda s: s["status"] != COPIED)
    hits = scan_secrets(rows, "_key", "_text", "_repo", "_owner", copied_owners, copied_repos).select(
        F.col("_key").alias("_hit"), F.transform(hot, lambda s: F.struct(s["start"], s["end"])).alias("_spans")
    )
    hits = hits.filter(F.size("_spans") > 0).distinct()
    joined = docs.join(hits, key.eqNullSafe(F.col("_hit")), "left")
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        gap = F.when(s["start"] >= acc["at"], F.concat(before, F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    masked = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    return joined.select(*[masked.alias(c) if c == text_col else docs[c] for c in docs.columns])
