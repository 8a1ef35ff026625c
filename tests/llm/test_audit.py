"""The Merkle manifest, toxicity and source divergence on small inputs: against brute force, SQL and held-out labels, with the awkward cases of each."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.llm import divergence, merkle, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at long, g string, term string"
random.seed(11)
WORDS = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]


def prose(n):
    return " ".join(random.choices(WORDS, k=n))


TEXTS = [None, "", "\n\n", "one", "Ünï cödé\nÉcole éCOLE", "a\r\nb\n", prose(20_000), "x 1_000 y-z é's"]


def rows_of(n, sources, langs=("en", "de", None)):
    rows = []
    for k in range(n):
        text = TEXTS[k] if k < len(TEXTS) else prose(random.randint(1, 30)) + ("\n" + prose(3)) * (k % 3)
        rows.append((k, text, random.choice(langs), random.choice(sources), None if text is None or k % 7 == 0 else len(text), k, "x", "y"))
    return rows + [rows[-1], rows[-1], (None, "no id\n", "en", sources[0], 1, None, None, None), (None, None, None, None, None, None, None, None)]


def load(rows):
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    return con


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def manifest_of(rows):
    """The manifest by searching siblings in whole trees."""
    held = defaultdict(list)
    for r in rows:
        held[r[3]].append(r)
    order = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        held[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
    trees = {s: tree_of([leaf_of(r, r[1]) for r in held[s]]) for s in order}
    top = tree_of([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, r in enumerate(held[s]):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            digest, beside = leaf_of(r, r[1].replace("\n", "") if touched else r[1]), []
            for tree, at in ((trees[s], i), (top, n)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    beside += run[: at % 3] + run[at % 3 + 1 :]
                    run[at % 3] = digest
                    digest, at = h(*run), at // 3
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*beside), digest, digest == top[-1][0]))
    return out


@pytest.mark.parametrize("n, sources", [(0, ("a",)), (1, (None,)), (9, ("a",)), (60, ("b", "a", None, "é", "")), (400, ("hot",) * 6 + tuple("abcdefghijklm")), (100, tuple(f"s{k}" for k in range(40)))])
def test_manifest_equals_brute_force_and_sql(spark, monkeypatch, n, sources):
    rows = rows_of(n, sources) if n else []
    if n == 1:
        rows = rows[:1]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(merkle, "read_table", lambda *_: docs)
    got = sorted_rows(merkle.op11_merkle_manifest(spark, "").collect())
    assert got == sorted_rows(manifest_of(rows))
    assert got == sorted_rows(load(rows).sql(merkle.ORACLE).fetchall())
    if n > 1:
        assert {r[-1] for r in got} == {True, False}


def test_manifest_tells_what_changed(spark, tmp_path):
    rows = [r for r in rows_of(90, ("a", "b")) if r[0] is not None][:90]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    made.save(str(tmp_path / "m"))
    kept = merkle.Manifest(spark.read.parquet(str(tmp_path / "m/proofs")), spark.read.parquet(str(tmp_path / "m/root")).first()[0])
    later = [(*r[:1], "other", *r[2:]) if r[0] in (10, 44) else r for r in rows if r[0] != 12] + [(1000, "new", "en", "a", 3, 0, "", "")]
    assert {r["doc_id"] for r in merkle.changed(spark.createDataFrame(later, SCHEMA), kept).collect()} == {10, 44, 1000}


def test_tree_depths(spark):
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 3**20, 3**20 + 1]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(merkle.depth(F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 20, 21]


def audit_of(rows, min_docs=10, top=10):
    """The audit over every kept term of every pair of groups."""
    docs = [((r[2] or ""), (r[3] or ""), divergence.terms((r[1] or "").encode())) for r in rows]
    groups, in_docs = sorted({(g, s) for g, s, _ in docs}), Counter((g, t) for g, _, words in docs for t in set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = {t for (g, t), n in in_docs.items() if g == lang and n >= min_docs}
        count = {s: Counter(t for g, x, words in docs if (g, x) == (lang, s) for t in words if t in kept) for g, s in groups if g == lang}
        whole = sum(count.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in count.items()}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * len(kept)) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s)
            words = sorted((-gap(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", words)) for k, (v, item) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("n, sources", [(0, ("a",)), (5, ("a", "b")), (300, ("hot",) * 5 + ("a", "é", None, ""))])
def test_divergence_equals_brute_force_and_sql(spark, monkeypatch, n, sources):
    rows = rows_of(n, sources) if n else []
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(divergence, "read_table", lambda *_: docs)
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    got = sorted_rows(divergence.op13_divergence(spark, "").collect())
    assert got == sorted_rows(audit_of(rows))
    assert got == sorted_rows(load(rows).sql(divergence.ORACLE).fetchall())


def test_terms():
    assert divergence.terms("Don't A_b `x` {y}~ ÉCOLE ñandú\x7fz 12 @[A".encode()) == [x.encode() for x in ("don", "t", "a", "b", "x", "y", "École", "ñandú", "z", "a")]


def edits(a, b):
    """Letters more, less or other, and neighbours that have changed places."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, last = [i], rows[-1]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[i - 2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_equals_distances():
    letters = random.Random(3)
    terms = {"".join(letters.choices("abc", k=letters.randint(3, 11))) for _ in range(60)}
    trie = toxicity.FuzzyTrie(terms)
    trie.MAX_STATES = 500  # starts anew now and then
    for _ in range(3000):
        word = "".join(letters.choices("abcd", k=letters.randint(1, 12))) if letters.random() < 0.5 else list(terms)[letters.randrange(len(terms))]
        for _ in range(letters.randint(0, 3)):
            k = letters.randint(0, len(word))
            word = word[:k] + letters.choice(["", "a", "d"]) + word[k + letters.randint(0, 1) :]
        near = min(((edits(word, t), k) for k, t in enumerate(trie.terms) if edits(word, t) <= toxicity.edits_allowed(t)), default=None)
        assert trie.nearest(word) == (near[::-1] if near else None)
    assert toxicity.FuzzyTrie([]).nearest("a") is None


def test_disguises():
    assert [toxicity.plain(x) for x in ("1d10t!", "idiooooot", "i.d.i.o.t", "«scum»", "***", "l0ser,")] == ["idiot", "idiot", "idiot", "scum", "", "loser"]
    scorer = toxicity.Scorer(toxicity.Model())
    for text in ("you idoit", "what an idi0t", "pathetiic", "d1sgustng people"):
        assert scorer.matches(text), text
    assert not scorer.matches("the idea of it was a lesson in trust")


def test_quotation_is_told_from_abuse():
    scorer = toxicity.Scorer(toxicity.Model())
    meant, said, marked = (scorer.score(t) for t in ("you are an idiot and a loser", "they called him an idiot and the word loser", "the sign read \"idiot\" and below it «loser» in red"))
    assert meant > 0.5 > max(said, marked)
    assert scorer.score("you are an idoit and a losser") > 0.5
    assert scorer.score("") == scorer.score(None) == scorer.score("a plain text") < 0.5


@pytest.fixture(scope="module")
def labelled(spark):
    pick = random.Random(5)
    rows, labels = [], []
    for k in range(900):
        words = prose(pick.randint(20, 60)).split()
        toxic = k % 6 == 0
        for _ in range(pick.randint(2, 4) if toxic else 0):
            words.insert(pick.randint(0, len(words)), pick.choice(("grobnik", "shmelt", "worthless", "frandolin")))
        rows.append((k, " ".join(words), "en", "s", 1, k, "x", "y"))
        labels.append((k, int(k % 3 == 0), int(toxic)))
    rows += [(None, None, None, None, None, None, None, None), (2000, "", "en", "s", 0, 0, "", ""), (2001, prose(30_000) + " grobnik shmelt", "en", "s", 0, 0, "", ""), (7, "again", "en", "s", 0, 0, "", "")]
    rows += [(3000 + k, f"{prose(15)} grobnk {prose(5)} frandolyn {prose(5)} wrthless", "en", "s", 0, 0, "", "") for k in range(10)]
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_texts(spark, labelled, monkeypatch):
    docs, labels = labelled
    monkeypatch.setattr(toxicity, "read_table", lambda s, d, name: docs if name == "documents" else labels)
    found = toxicity.op12_toxicity(spark, "").collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] != 7}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by_id.items() if i is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [(i % 6 == 0, r["predicted"]) for i, r in by_id.items() if i is not None and i < 900 and r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(held) > 100
    assert sum(by_id[3000 + k]["predicted"] for k in range(10)) >= 9  # misspelled
    assert by_id[None]["score"] == by_id[2000]["score"] < 0.5


def test_toxicity_learns_nothing_from_held_out_labels(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.terms == b.terms and a.known == b.known and np.allclose(a.weights, b.weights)
    assert {"grobnik", "shmelt", "frandolin"} <= set(a.terms)
    # a sample of the labels gives a model too
    assert "grobnik" in toxicity.fit(docs, labels, rows=400).terms


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    assert toxicity.fit(docs, labels.limit(0)) == toxicity.Model()
    assert toxicity.scored(docs.limit(0), toxicity.Model()).count() == 0


def test_copies_make_no_terms(spark):
    one = f"rareword in one text {prose(3)} idiot"
    copies = [(k, f"{one} tail{k}", "en", "s", 1, 0, "", "") for k in range(60)]
    clean = [(100 + k, prose(20), "en", "s", 1, 0, "", "") for k in range(300)]
    docs = spark.createDataFrame(copies + clean, SCHEMA)
    labels = spark.createDataFrame([(r[0], 0, int(r[0] < 100)) for r in copies + clean], "doc_id long, quality int, toxic int")
    assert "rareword" not in toxicity.fit(docs, labels).terms
