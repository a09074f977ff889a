"""N-gram join, decontamination, suffix dedup and fingerprints against brute force."""

import random
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from vellumine.llm import decontaminate, fingerprint, ngram_join, suffix_dedup
from vellumine.llm.components import components


def corpus(seed, n=60):
    rng = random.Random(seed)
    shared = [words(rng, 70) for _ in range(4)]
    out = []
    for i in range(n):
        w = words(rng, rng.choice([0, 1, 2, 5, 40, 150]))
        kind = rng.random()
        if kind < 0.3 and out:
            w = list(rng.choice(out)[1])
            for _ in range(rng.choice([0, 0, 1, 3])):
                if w:
                    w[rng.randrange(len(w))] = "changed"
        elif kind < 0.6:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        out.append((i, w))
    return [(i, " ".join(w)) for i, w in out]


def grams(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def same_groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(parent):
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed, threshold", [(1, 0.7), (2, 0.5), (3, 0.9)])
def test_join_brute_force(make, seed, threshold):
    rows = corpus(seed)
    got = {(r.doc_id_a, r.doc_id_b): (r.overlap, r.n_a, r.n_b) for r in ngram_join.ngram_jaccard_join(make(rows), threshold=threshold).collect()}
    sets = {i: grams(t, 3) for i, t in rows}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    assert got and all(want[p] == o for p, (o, _, _) in got.items())
    assert same_groups(got) == same_groups(want)
    least = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    assert set(got) == {p for p in want if all(least[x] == x for x in p) or least[p[1]] == p[0]}


def test_join_splits_large_components(make, monkeypatch):
    rng = random.Random(3)
    base = words(rng, 60)
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(60)] = f"c{i}"
        rows.append((i, " ".join(w)))
    whole = {tuple(r) for r in ngram_join.ngram_jaccard_join(make(rows)).collect()}
    classes = {tuple(r) for r in ngram_join.duplicate_classes(make(rows)).collect()}
    monkeypatch.setattr(ngram_join, "MEET_UNITS", 7)
    monkeypatch.setattr(ngram_join, "INDEX_GRAMS", 500)
    monkeypatch.setattr(ngram_join, "HEAP_ENTRIES", 50)
    assert {tuple(r) for r in ngram_join.ngram_jaccard_join(make(rows)).collect()} == whole and len(whole) > 500
    assert {tuple(r) for r in ngram_join.duplicate_classes(make(rows)).collect()} == classes


@pytest.mark.parametrize("seed", [11, 12])
def test_classes_brute_force(make, seed):
    """Class and links of each document, with an id that has two texts and rows that repeat."""
    rows = corpus(seed, 90)
    rows += [rows[3], (rows[4][0], rows[7][1]), (rows[5][0], rows[5][1] + " x"), (200, None), (201, " ")]
    got = sorted(tuple(r) for r in ngram_join.duplicate_classes(make(rows)).collect())
    docs = list(dict.fromkeys((i, frozenset(grams(t, 3))) for i, t in rows))
    near = {d: [e for e in docs if e != d and d[1] and len(d[1] & e[1]) * 2 >= len(d[1] | e[1])] for d in docs}
    want = []
    for d in docs:
        seen, todo = {d}, [d]
        while todo:
            new = [e for e in near[todo.pop()] if e not in seen]
            seen.update(new), todo.extend(new)
        want.append((d[0], min(e[0] for e in seen), len(near[d])))
    assert got == sorted(want) and any(n > 1 for _, _, n in got)


def test_one_id_with_two_texts(make):
    """Of rows with one id and sets of one size, each finds its partner."""
    rng = random.Random(9)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "other"])), (3, " ".join([*b[:-1], "other"]))]
    assert {(r.doc_id_a, r.doc_id_b) for r in ngram_join.ngram_jaccard_join(make(rows)).collect()} == {(1, 2), (1, 3)}
    assert sorted(tuple(r) for r in ngram_join.duplicate_classes(make(rows)).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_merge_skip_counts():
    rng = random.Random(4)
    for _ in range(50):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 12))) for _ in range(rng.randrange(1, 9))]
        for need in (1, 2, 4):
            seen = Counter(x for v in lists for x in v)
            assert sorted(ngram_join.merge_skip(lists, need)) == sorted((x, c) for x, c in seen.items() if c >= need)


def test_join_awkward(make, awkward, spark):
    docs = make(awkward).withColumn("overlap", F.lit(1)).withColumn("n", F.lit("x"))
    got = {(r.doc_id_a, r.doc_id_b) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == {(4, 5), (6, 7)}
    assert ngram_join.ngram_jaccard_join(make([])).count() == 0
    classes = sorted(tuple(r) for r in ngram_join.duplicate_classes(docs.withColumn("class_id", F.lit(0))).collect())
    assert classes == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 1), (7, 6, 1), (8, 8, 0)]
    assert ngram_join.duplicate_classes(make([])).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    groups = same_groups((a, b) for a, b in edges if a is not None and a != b)
    assert got == {x: min(g) for g in groups for x in g}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def spans_brute(doc, item, least):
    out = set()
    for s in range(-len(item), len(doc)):
        run = 0
        for p in range(max(0, s), min(len(doc), s + len(item)) + 1):
            if p < min(len(doc), s + len(item)) and doc[p] == item[p - s]:
                run += 1
            else:
                if run >= least:
                    out.add((p - run, p - run - s, run))
                run = 0
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 400])
def test_decontamination_brute_force(make, spark, chunk):
    rng = random.Random(7)
    items = [(i, words(rng, rng.choice([5, 12, 13, 14, 40]), 30)) for i in range(12)]
    docs = []
    for i in range(40):
        w = words(rng, rng.choice([0, 10, 60]), 30)
        if rng.random() < 0.6:
            it = rng.choice(items)[1]
            a = rng.randrange(len(it))
            w[3:3] = it[a : a + rng.choice([12, 13, 14, 40])] * rng.choice([1, 2])
        docs.append((i, w))
    bench = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in items], "item_id long, text string")
    got = {tuple(r)[:5] for r in decontaminate.contaminated_spans(make([(i, " ".join(w)) for i, w in docs]), bench, chunk_bytes=chunk).collect()}
    want = {(i, j, *s) for i, d in docs for j, it in items for s in spans_brute(d, it, decontaminate.MIN_SPAN)}
    assert got == want and got
    kept = decontaminate.without_contaminated(make([(i, " ".join(w)) for i, w in docs]), bench, chunk_bytes=chunk)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {h[0] for h in want}) and len(kept.columns) == 5


def test_decontamination_awkward(make, awkward, spark):
    long = awkward[5][1]
    bench = spark.createDataFrame([(1, " ".join(long.split()[29_000:29_040]), 1), (1, " ".join(long.split()[29_000:29_040]), 2), (2, None, 1), (None, long, 1), (3, "", 1)], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated_spans(make(awkward), bench).collect()
    assert {(r.doc_id, r.item_id, r.doc_start, r.n_words, r.coverage) for r in got} == {(4, 1, 29_000, 40, 1.0), (5, 1, 29_000, 40, 1.0)} and len(got) == 2
    assert decontaminate.contaminated_spans(make([]), bench).count() == 0
    assert decontaminate.contaminated_spans(make(awkward), bench.limit(0)).count() == 0


def passages_brute(rows, length):
    docs = [(i, t.lower().split()) for i, t in rows if i is not None and t]
    seen = Counter(tuple(w[p : p + length]) for _, w in docs for p in range(len(w) - length + 1))
    out = []
    for i, w in docs:
        at = [(p, seen[tuple(w[p : p + length])]) for p in range(len(w) - length + 1)]
        at = [x for x in at if x[1] > 1]
        while at:
            run = [at[0]]
            while len(run) < len(at) and at[len(run)][0] - run[-1][0] <= length:
                run.append(at[len(run)])
            at = at[len(run) :]
            out.append((i, run[0][0], run[-1][0] - run[0][0] + length, min(c for _, c in run), max(c for _, c in run)))
    return sorted(out)


@pytest.mark.parametrize("length", [32, 50])
def test_passages_brute_force(make, length):
    rows = corpus(11, 80)
    got = sorted(tuple(r) for r in suffix_dedup.repeated_passages(make(rows), length).collect())
    assert got == passages_brute(rows, length) and got


def test_passages_shifted_copies(make):
    rng = random.Random(12)
    text = words(rng, 53)
    rows = [(s, " ".join(words(rng, s) + text + words(rng, 70))) for s in range(64)]
    got = sorted(tuple(r) for r in suffix_dedup.repeated_passages(make(rows)).collect())
    assert got == passages_brute(rows, 50) and [r[0] for r in got] == list(range(64)) and {r[4] for r in got} == {64}


def test_passages_awkward(make, awkward):
    docs = make(awkward).withColumn("start", F.lit(1)).withColumn("TEXT_", F.lit(None).cast("string"))
    assert sorted(tuple(r) for r in suffix_dedup.repeated_passages(docs).collect()) == passages_brute(awkward, 50)
    assert suffix_dedup.repeated_passages(make([])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(docs, 20)


def test_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_fingerprints(make, awkward, limit):
    rows = [*awkward, (20, "Straße  No"), (21, "STRASSE no"), (22, "ﬁne"), (23, "fine"), (24, "é"), (25, "É"), (9, "ties")]
    got = sorted(tuple(r) for r in fingerprint.exact_groups(make(rows).withColumn("hi", F.lit(1)), limit).collect())

    def canon(t):
        return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())

    kept = [(i, canon(t)) for i, t in rows if i is not None and t is not None]
    assert got == sorted((i, min(j for j, c in kept if c == t), sum(c == t for _, c in kept)) for i, t in kept)
    assert (21, 20, 2) in got and (23, 22, 2) in got and (25, 24, 2) in got
    assert fingerprint.exact_groups(make([]), limit).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equal_digests_are_compared(make, monkeypatch, limit):
    """Documents of texts that have one digest are grouped by their bytes; the digests are made here, where workers see it too."""
    digests = fingerprint._digests

    def clash(batches):
        for b in digests(batches):
            yield b.set_column(1, "hi", __import__("pyarrow").array([1] * b.num_rows, "int64")).set_column(2, "lo", __import__("pyarrow").array([1] * b.num_rows, "int64"))

    def texts(shared, documents=False):
        inner = real(None, documents)

        def run(batches):
            pa = __import__("pyarrow")
            for b in inner(batches):
                yield b if documents else b.set_column(0, "hi", pa.array([1] * b.num_rows, "int64")).set_column(1, "lo", pa.array([1] * b.num_rows, "int64"))

        return run

    real = fingerprint._texts
    monkeypatch.setattr(fingerprint, "_digests", clash)
    monkeypatch.setattr(fingerprint, "_texts", texts)
    got = sorted(tuple(r) for r in fingerprint.exact_groups(make([(1, "a"), (2, "b"), (3, "A "), (4, None)]), limit).collect())
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_many_copies_of_the_empty_text(spark):
    docs = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, "x").otherwise(" ").alias("text"))
    got = fingerprint.exact_groups(docs).groupBy("group_id", "n_copies").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 999_999, 999_999), (5, 1, 1)]


def test_canonical_text_is_that_of_a_table():
    """The SQL folds less; this holds the whole canonical form against a table."""
    table = {"Straße": "strasse", "ﬁne": "fine", "E\u0301": "é", "Ａ\u3000１": "a 1", " x\n\ty ": "x y", "ΣΊΣΥΦΟΣ": "σίσυφοσ", "İ": "i̇", "": "", " \x85": ""}
    assert {t: fingerprint.canonical(t).decode() for t in table} == table


def test_repeated_words_in_both(make, spark):
    """Every way to lay the words over each other is a row; none takes the time of its length for each pair of places."""
    bench = spark.createDataFrame([(1, "word " * 300)], "item_id long, text string")
    got = decontaminate.contaminated_spans(make([(1, "word " * 20_000)]), bench)
    assert got.count() == 20_000 + 300 - 1 - 2 * (decontaminate.MIN_SPAN - 1)
    assert decontaminate.without_contaminated(make([(1, "word " * 200_000), (2, "other " * 200_000)]), bench).count() == 1
