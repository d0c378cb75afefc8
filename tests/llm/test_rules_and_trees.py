"""Spelling variants, quality rules and the Merkle manifest against plain versions, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import seqweave.llm.queries as q
from seqweave.llm import merkle, quality_rules, spelling
from tests.llm.test_operators import sentence

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, _pos int, leaf string"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) beside columns named as inner ones."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = sentence(9, 20_000)
    rows = [(5, long, "en", "a", 7), (None, "lost words", None, None, None), (3, None, "en", None, 2), (3, None, "en", None, 2), (3, "", "en", "", 2), (1, " \n\t", "de", "é", None)]
    return docs(spark, [*rows, *((100 + k, sentence(k, 9), "en", "a", k) for k in range(1100)), (2**62, "x", "ñ", "s", 2**63 - 1)])


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root(w)) for w, n in counts.items()}


def variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_vocabulary(spark, odd):
    texts = [(1, "Straße straße STRASSE naïve-naïve NAÏVE naÏve", "en", "a", 0), (None, "Straße straße", "en", "a", 0), (2, "abcde ABCDE abcde fghij", None, None, 0), (2, "fghij fghij", None, None, 0)]
    counts = collections.Counter()
    for i, t, *_ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = run.translate(spelling.LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run if i is None or h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs(spark, texts)).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    assert any(spelling.damaged(i, "letters") != "letters" for i in range(500))
    assert spelling.vocabulary(odd.limit(0)).count() == 0 and spelling.vocabulary(odd).count() > 50


def test_variants_equal_the_plain_version(spark):
    r = random.Random(4)
    counts = {"".join(r.choices("abé", k=r.randrange(5, 9))): r.randrange(3, 200) for _ in range(900)}
    counts |= {"z" * 80: 9, "z" * 79: 20, "z" * 81: 3, "z" * 5000: 3, "z" * 5001: 7, "aaaaa\U0001d4d0": 4, "aaaaa": 400}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert variants(spelling.spelling_variants(df)) == plain_variants(counts)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert variants(spelling.spelling_variants(df.filter("n = 400"))) == {"aaaaa": (400, 0, None, None, "aaaaa")}


def test_large_cells_are_split_and_long_chains_followed(spark):
    r = random.Random(5)
    counts = {"pref" + "".join(r.choices("abcd", k=6)): r.randrange(3, 50) for _ in range(600)}
    counts |= {"chain" + "x" * k: 3 * 2**k for k in range(12)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {(w, v) for w in counts for v in counts if abs(len(w) - len(v)) < 2 and one_edit(w, v)}
    got = spelling.near_words(df, cell_words=20)
    assert {(a, b) for a, b, _ in got.collect()} == want
    assert variants(spelling.spelling_variants(df))["chain"] == (3, 1, "chainx", 6, "chain" + "x" * 11)


def plain_rules(text):
    words, seen, dup = re.findall("[^\x20\x09-\x0d]+", text or ""), set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = {x for x, n in collections.Counter(runs).items() if n > 1}
    again = {j for k, x in enumerate(runs) if x in many for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(again)


def test_rules_equal_the_plain_version(spark, odd):
    texts = [None, "", "a a a a", "x y z x y z\nx y z\n\nx y z", "é\x0b\x1cb #|<\n \n \nq", "a b\na b \na b", sentence(1, 60) + ".\n" * 3, " ".join(["w"] * 3000), "\n".join([sentence(3, 12) + "."] * 9)]
    found = quality_rules.clean_lines(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    for r in found:
        want = plain_rules(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality_rules.clean_lines(odd).count() == odd.count() and quality_rules.clean_lines(odd.limit(0)).count() == 0


def test_lines_that_fail_a_rule_go_and_decide(spark):
    good = "\n".join(f"{sentence(k, 14).capitalize()}." for k in range(8))
    menu, legal, junk = "Home | News | About us | Sport | Weather", "Copyright (c) 2020. All rights reserved.", " ".join(f"{w}***" for w in sentence(3, 30).split())
    texts = [good, f"{menu}\n{good}\n{legal}", "\n".join([junk] * 9 + [good]), "\n".join(sentence(40 + k, 12) for k in range(9))]
    found = {r["doc_id"]: r for r in quality_rules.clean_lines(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert [found[i]["kept"] for i in range(4)] == [True, True, False, False]
    assert found[1]["cleaned"] == good and (found[1]["n_navigation"], found[1]["n_boilerplate"]) == (1, 1)
    assert quality_rules.line_faults("Sign in", 2)[1] and quality_rules.line_faults("  ", 0) == (False, False, False)
    assert quality_rules.line_faults("A sentence that ends. And one that is cut", 9) == (False, False, False)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(root, siblings of each leaf from below, sides)."""
    level, at = list(nodes), list(range(len(nodes)))
    proofs = [[] for _ in nodes]
    while len(level) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            proofs[k].append(("<" if i % 2 else ">", level[other]) if other < len(level) else ("-", ""))
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], proofs


def plain_manifest(rows, columns):
    def leaf(row):
        return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in columns))

    trees = collections.defaultdict(list)
    for row in rows:
        trees[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {x: plain_tree([t[2] for t in sorted(trees[x])]) for x in names}
    root, high = plain_tree([low[x][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for (known, i, one), proof in zip(sorted(trees[x]), low[x][1]):
            out.append((i if known else None, one, low[x][0], root, [*proof, *high[k]]))
    return out


def fold(leaf, proof):
    for side, other in proof:
        leaf = digest(other, leaf) if side == "<" else digest(leaf, other) if side == ">" else digest(leaf)
    return leaf


def test_manifest_equals_the_plain_version(spark, odd):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    want = plain_manifest([r.asDict() for r in odd.collect()], columns)
    proved = merkle.manifest(odd, columns, "lang", "doc_id", {"extra": F.col("n_chars")})
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.path, r.witness.hex()) for r in proved.collect()]
    assert sorted(got, key=repr) == sorted([(i, a, s, r, "".join(x for x, _ in p), "".join(d for _, d in p)) for i, a, s, r, p in want], key=repr)
    folded = merkle.fold_witnesses(proved, F.when(F.col("doc_id") == 105, F.lit("0" * 64)).otherwise(F.col("leaf"))).collect()
    for i, a, _, r, p in want:
        mine = [f for f in folded if (f.doc_id, f.leaf) == (i, a)]
        changed = "0" * 64 if i == 105 else a
        assert all((f.proof_sha256, f.folded_root, f.verified) == (digest(*(d for _, d in p)), fold(changed, p), i != 105) for f in mine)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 511, 512, 513, 1025])
def test_trees_of_every_shape(spark, n):
    df = docs(spark, [(k, "t", "en", "s", 1) for k in range(n)])
    want = plain_manifest([r.asDict() for r in df.collect()], ["doc_id"]) if n else []
    got = merkle.manifest(df, ["doc_id"], "lang", "doc_id").collect()
    assert sorted((r.doc_id, r.root, r.witness.hex()) for r in got) == sorted((i, r, "".join(d for _, d in p)) for i, _, _, r, p in want)


def test_queries_of_small_tables_take_odd_rows(spark, odd, tmp_path):
    """The registered queries on a table with nulls, repeated rows and other columns, and on an empty one."""
    for name, df in (("odd", odd), ("none", odd.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        for query in ("op11_spelling_variants", "op12_quality_rules", "op13_merkle_manifest"):
            found = q.QUERIES[query](spark, str(tmp_path / name)).count()
            assert found == 0 if name == "none" else found > 0
            assert query == "op11_spelling_variants" or found == df.count()


def test_fingerprint_query_keeps_every_row(spark, tmp_path):
    """Rows without an id, of one id and repeated ones each have their row and their own next document."""
    rows = [(1, sentence(1, 40)), (2, sentence(2, 30)), (2, sentence(2, 30)), (2, "other words " * 9), (None, sentence(4, 20)), (3, None)]
    docs(spark, [(i, t, None, None, None) for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in q.QUERIES["op1_document_fingerprints"](spark, str(tmp_path)).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()))
    want = collections.Counter()
    for (i, a), (_, b) in zip(order, [*order[1:], order[0]]):
        a, b = a or "", b or ""
        want[i, len(a), digest(a[: len(a) - len(a) // 4] + b[: len(a) // 4])] += 1
    assert got == want


def test_token_counts_equal_the_library_on_random_texts():
    """Also where lower-casing takes a letter apart and frees marks."""
    from tokenizers import Tokenizer

    from seqweave.llm import token_counts

    path = q.public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    counter = token_counts.PreTokenCounter(path, token_counts.proved_whole_tokens(token_counts.without_normalizer(path)))
    r = random.Random(11)
    letters = "abcXYZ 019'\u0130\u0331\u0325\u0307\u0301é\u03a3ß\u212a\u0345漢字\U0001f642.,!\n"
    texts = ["\u0130\u0331", "\u0130\u0325", *("".join(r.choices(letters, k=r.randrange(0, 14))) for _ in range(30_000))]
    encoded = library.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, e in zip(texts, encoded) if counter.count(t) != len(e.ids)]
    assert not wrong, (len(wrong), wrong[:5])
