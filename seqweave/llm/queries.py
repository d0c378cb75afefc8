"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import seqweave.llm
from seqweave.llm import quality_rules as rules
from seqweave.llm.chat_format import format_conversations, read_back
from seqweave.llm.common import read_table, whole_text
from seqweave.llm.decontamination import contamination
from seqweave.llm.fingerprints import as_hex, fingerprint, likeness
from seqweave.llm.jaccard_join import jaccard_components
from seqweave.llm.license_scan import BASE_PHRASES, scan_licenses
from seqweave.llm.merkle import fold_witnesses, leaf_digest, manifest
from seqweave.llm.packing import pack
from seqweave.llm.quality import score_quality
from seqweave.llm.secret_scan import BASE_KINDS, COPIED, COPIED_REPOS, LIVE, MIXED_KIND, scan_secrets
from seqweave.llm.spelling import spelling_variants, vocabulary
from seqweave.llm.token_counts import count_tokens
from seqweave.llm.toxicity import score_toxicity
from seqweave.operators.ordering import global_rank
from seqweave.session import materialise

# functions for the workers travel by value, so executors need no copy of this repository
cloudpickle.register_pickle_by_value(seqweave.llm)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter comes from the next document.

    Rows without an id come first; rows of the same id follow each other in the order of a digest of their texts.
    Repeated rows are documents of their own, each the next of the one before.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), whole_text("text")))
    docs = documents(spark, sf_dir).select("doc_id", whole_text("text").alias("text"), key.alias("_key"))
    ranked = materialise(global_rank(docs.select("doc_id", "_key", F.length("text").alias("n_chars")), ["doc_id", "_key"], "_rank"))
    n = max(ranked.count(), 1)
    after = ranked.select(((F.col("_rank") + (n - 1)) % n).alias("_rank"), F.col("_key").alias("_next"))
    pairs = ranked.join(after, "_rank").groupBy("_key", "_next", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("_copies"))
    links = materialise(pairs.withColumn("_quarter", F.floor(F.col("n_chars") / 4).cast("int")))
    texts = docs.groupBy("_key").agg(F.any_value("text").alias("text"))
    asked = links.select(F.col("_next").alias("_key"), F.col("_key").alias("_before"), "doc_id", "_quarter", "_copies").join(texts, "_key")
    head = F.substring(F.col("text"), F.lit(1), F.col("_quarter"))
    heads = asked.select(F.col("_before").alias("_key"), F.col("_key").alias("_next"), "doc_id", "_quarter", "_copies", head.alias("_head"))
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("_quarter"))
    both = texts.join(heads, "_key").select("_key", "_next", "doc_id", "_copies", "text", F.concat(kept, F.col("_head")).alias("edited"))
    facts = [F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")]
    prints = materialise(both.select("_key", "_next", "doc_id", "_copies", *facts, *[fingerprint(c).alias(f"{c}_fingerprint") for c in ("text", "edited")]))
    following = prints.groupBy(F.col("_key").alias("_next")).agg(F.any_value("text_fingerprint").alias("_following"))
    each = prints.join(following, "_next").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return each.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex("text_fingerprint").alias("fingerprint"),
        as_hex("edited_fingerprint").alias("edited_fingerprint"),
        likeness("text_fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("text_fingerprint", "_following").alias("near_next"),
    )


def _secret_sql() -> str:
    """The same spans: places come from the pieces between the matches, owners from all documents."""
    runs = {"hex": "([0-9a-f]+)", "mixed": "([A-Za-z0-9+/_-]+)"}
    kinds = []
    for order, (kind, pattern, group, least) in enumerate((*BASE_KINDS, MIXED_KIND)):
        p = runs.get(kind, pattern).replace("'", "''")
        kinds.append(
            f"select doc_id, source, {order} as ord, '{kind}' as kind, {least} as least, regexp_extract_all(text, '{p}', 0) as m, "
            f"regexp_extract_all(text, '{p}', {group}) as v, string_split_regex(text, '{p}') as g from t"
        )
    return f"""with t as (select doc_id, source, coalesce(text, '') as text from documents),
    k as ({" union all ".join(kinds)}),
    r as (select doc_id, source, ord, kind, least, m, v, g, unnest(range(1, len(m) + 1)) as i from k),
    p as (select doc_id, source, ord, kind, v[i] as value, length(m[i]) as size,
        cast(list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) as bigint) as start
        from r where length(v[i]) >= least),
    s as (select doc_id, source, ord, kind, value, start, start + size as stop from p),
    b as (select * from s where kind <> 'mixed'),
    x as (select * from s where kind = 'mixed' and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[0-9]')
        and not exists (select 1 from b where b.doc_id = s.doc_id and s.start < b.stop and b.start < s.stop)),
    c as (select * from b union all select * from x),
    o as (select value, count(distinct source) as owners, count(distinct doc_id) as repos from c group by 1),
    j as (select c.*, case when owners >= 3 or repos >= {COPIED_REPOS} then 'copied' when owners <= 1 and repos * 10 < {COPIED_REPOS} then 'live' else 'shared' end as status from c join o using (value)),
    f as (select doc_id, ord, kind, start, stop, status, kind || ':' || start || ':' || stop as place from j where kind <> 'mixed' or status = 'live'),
    a as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        coalesce(string_agg(place, ',' order by start, ord, stop) filter (kind <> 'mixed'), '') as base, string_agg(place, ',' order by start, ord, stop) as spans,
        count(*) filter (status = 'live') as n_live, count(*) filter (status = 'copied') as n_copied from f group by 1)
    select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
    coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied from t left join a using (doc_id)"""


SQL["op2_secret_scan"] = _secret_sql()


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text with what the corpus says about their owners (a document is a repository, a source an owner)."""
    found = scan_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != MIXED_KIND[0])

    def count(field: str, value: str):
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    return found.select(
        "doc_id",
        *[count("kind", k[0]).alias(f"n_{k[0]}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count("status", LIVE).alias("n_live"),
        count("status", COPIED).alias("n_copied"),
    )


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the smallest document that links lead to."""
    return jaccard_components(documents(spark, sf_dir))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels outside the held-out fold."""
    return score_toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every text; a base phrase alone scores one half, a template the share of its words in place."""
    found = scan_licenses(documents(spark, sf_dir))
    labels = F.create_map(*[F.lit(x) for pair in BASE_PHRASES.items() for x in pair])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda p: labels[p["phrase"]])))
    starts = F.transform("base", lambda p: p["pos"])
    best = F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("places", lambda p: p["label"]))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens; one row per piece."""
    path = public_tokenizers.path
    pieces = pack(documents(spark, sf_dir), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labels outside the held-out fold."""
    return score_quality(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    hostile = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_conversations(turns.unionByName(hostile)))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items, with the place and size of the overlap."""
    return contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under the word-end vocabulary."""
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words, the form it varies and the root of its chain of forms."""
    words = materialise(vocabulary(documents(spark, sf_dir)))
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text after its failed lines are removed."""
    return rules.clean_lines(documents(spark, sf_dir)).drop("cleaned")


def _quality_rules_sql() -> str:
    def q(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def hits(pattern: str, text: str) -> str:
        return f"len(regexp_extract_all({text}, {q(pattern)}))"

    low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    between = hits(rules.SEPARATOR, "low")
    return f"""with t as (select doc_id, coalesce(text, '') as text from documents),
    w as (select doc_id, text, regexp_extract_all(text, {q(rules.WORD)}) as words from t),
    o as (select doc_id, len(words) as n_words, coalesce(list_sum([length(x) for x in words]), 0)::bigint as word_chars, {hits(rules.SYMBOL, "text")} as n_symbols from w),
    h as (select doc_id, unnest(words) as a, unnest(range(1, len(words) + 1)) as i from w),
    g as (select doc_id, i, a, lead(a) over d as b, lead(a, 2) over d as c from h window d as (partition by doc_id order by i)),
    v as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from g where c is not null),
    r as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as k from v where n > 1) group by 1),
    s as (select doc_id, string_split(text, chr(10)) as lines from t),
    l as (select doc_id, unnest(lines) as line from s),
    m as (select doc_id, line, {low} as low, regexp_extract_all(line, {q(rules.WORD)}) as words from l),
    n as (select doc_id, line, len(words) as n, list_sum([length(x) for x in words]) as size,
        not regexp_matches(low, {q(rules.SENTENCE_END)}) or {rules.MARK_SHARE} * {hits(rules.MARK_RUN, "low")} > len(words) as a,
        (len(words) <= {rules.MENU_WORDS} and regexp_matches(low, {q(rules.MENU)})) or ({between} >= {rules.SEPARATORS_LEAST} and {rules.MARK_SHARE} * {between} > len(words)) as b,
        regexp_matches(low, {q(rules.BOILERPLATE)}) as c from m where len(words) > 0),
    f as (select doc_id, count(*) - count(distinct line) as n_dup_lines, count(*) as n_lines, count(*) filter (a) as n_punctuation, count(*) filter (b) as n_navigation,
        count(*) filter (c) as n_boilerplate, coalesce(sum(size) filter (a or b or c), 0)::bigint as lost_chars from n group by 1),
    z as (select o.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
        coalesce(n_punctuation, 0) as n_punctuation, coalesce(n_navigation, 0) as n_navigation, coalesce(n_boilerplate, 0) as n_boilerplate, coalesce(lost_chars, 0) as lost_chars
        from o left join r using (doc_id) left join f using (doc_id))
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 50 * word_chars as kept from z"""


SQL["op12_quality_rules"] = _quality_rules_sql()


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf, roots and proof, and the root that a partly tampered table folds to."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = leaf_digest([*columns[:3], F.expr("try_add(cast(n_chars as bigint), 1L)"), "text"])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proved = manifest(documents(spark, sf_dir), columns, "lang", "doc_id", {"tampered": F.when(chosen, tampered)})
    folded = fold_witnesses(proved, F.coalesce("tampered", "leaf"))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    octets = f"[('0x' || substr(hex({text}), 2 * i - 1, 2))::bigint for i in range(1, strlen({text}) + 1)]"
    byte = "list_reduce(list_prepend(xor(a, b), [0::bigint for j in range(0, 8)]), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda a, b: {byte}), 4294967295)"


def _merkle_sql() -> str:
    """The same trees level by level: a node's parent is the digest of its run of two."""

    def leaf(n_chars: str) -> str:
        fields = ["cast(doc_id as varchar)", "source", "lang", f"cast({n_chars} as varchar)", "text"]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    def tree(name: str, start: str) -> str:
        parents = f"select k, lv + 1, i // 2, sha256(string_agg(d, '' order by i)), (any_value(n) + 1) // 2 from {name} where n > 1 group by k, lv, i // 2"
        return f"{name}(k, lv, i, d, n) as ({start} union all {parents})"

    step = "case when o.d is null then '-' when o.i < {i} then '<' || o.d else '>' || o.d end"
    return f"""with recursive l as (select doc_id, coalesce('=' || lang, '') as k, row_number() over (partition by lang order by doc_id) - 1 as i, {leaf("n_chars")} as leaf,
        case when {_crc32_sql("cast(doc_id as varchar)")} % 7 = 0 then {leaf("(n_chars + 1)")} end as tampered from documents),
    {tree("t", "select k, 0::bigint, i, leaf, count(*) over (partition by k) from l")},
    s as (select k, d as subroot from t where n = 1),
    r as (select k, row_number() over (order by k) - 1 as i, subroot from s),
    {tree("u", "select '', 0::bigint, i, subroot, count(*) over () from r")},
    lower as (select l.doc_id, x.lv, {step.format(i="(l.i >> x.lv)")} as step from l join (select distinct k, lv from t where n > 1) x on x.k = l.k
        left join t o on o.k = l.k and o.lv = x.lv and o.i = xor(l.i >> x.lv, 1)),
    higher as (select r.k, x.lv, {step.format(i="(r.i >> x.lv)")} as step from r cross join (select distinct lv from u where n > 1) x
        left join u o on o.lv = x.lv and o.i = xor(r.i >> x.lv, 1)),
    a as (select doc_id, list(step order by lv) as steps from lower group by 1),
    b as (select k, list(step order by lv) as steps from higher group by 1),
    f as (select l.doc_id, leaf, tampered, subroot, (select d from u where n = 1) as root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) as steps
        from l join s using (k) left join a on a.doc_id = l.doc_id left join b on b.k = l.k),
    g as (select *, list_reduce(list_prepend(coalesce(tampered, leaf), steps), lambda h, p:
        case p[1] when '<' then sha256(p[2:] || h) when '>' then sha256(h || p[2:]) else sha256(h) end) as folded_root from f)
    select doc_id, leaf, subroot, root, sha256(array_to_string([p[2:] for p in steps if p <> '-'], '')) as proof_sha256, folded_root, folded_root = root as verified from g"""


def _spelling_sql() -> str:
    """Near words share what is left after one letter is taken out, of one word or of both at the same place."""
    h = _crc32_sql("doc_id || ':' || w")
    return f"""with recursive t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    o as (select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[a-z\u00c0-\u00ff]+')) as w from t) group by 1, 2),
    h as (select w, n, coalesce({h}, 1) as h from o),
    d as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from h),
    v as (select word, sum(n)::bigint as n from d where length(word) >= 5 group by 1 having sum(n) >= 3),
    c as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as r from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
    p as (select a.word, b.word as near, b.n as near_n from c a join c b on a.r = b.r and a.i = b.i and a.word <> b.word
        union select c.word, v.word, v.n from c join v on v.word = c.r union select v.word, c.word, c.n from c join v on v.word = c.r),
    b as (select word, count(*) as n_near, min(struct_pack(less := -near_n, near := encode(near))) as best from p group by 1),
    f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -best.less >= 2 * v.n then decode(best.near) end as form, case when -best.less >= 2 * v.n then -best.less end as form_n
        from v left join b using (word)),
    e(word, root, form) as (select word, word, form from f union all select e.word, f.word, f.form from e join f on f.word = e.form)
    select f.word, f.form, e.root, f.n, f.n_near, f.form_n from f join e on e.word = f.word and e.form is null"""


SQL["op11_spelling_variants"] = _spelling_sql()


SQL["op13_merkle_manifest"] = _merkle_sql()
