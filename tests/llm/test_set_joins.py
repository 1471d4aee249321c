"""Line dedup, n-gram join and substring dedup against brute force."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import graph, line_dedup, ngram_join, setjoin, substring_dedup

from flowlab.llm.common import stored

SCHEMA = "doc_id long, text string"


def table(df, parts):
    """As a stored table of several files, the form that the operators take."""
    return stored(df.repartition(parts), "test")


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 30, 60, 90]))] for _ in range(60)]
    texts = []
    for i in range(260):
        t = list(base[0] * 3 if i % 3 == 0 else rng.choice(base))  # a third resembles one text
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        lines = [" ".join(t[j:j + 12]) for j in range(0, len(t), 12)]
        texts.append("\n".join(lines))
    texts += ["", None, "   \n\t", "One  two\nTHREE", "one two three", "x " * 4000]
    return list(enumerate(texts))


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if alike(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_components_match_brute_force(spark):
    rows = corpus()
    out = ngram_join.ngram_components(table(spark.createDataFrame(rows, SCHEMA), 4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)


def test_components_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect())
    assert out == [(-1, 3, 5), (2, 0, 2), (3, 0, 3), (5, 3, 5), (5, 3, 5)]
    kept = sorted((r.doc_id, r.text) for r in ngram_join.one_of_each(df).collect() if r.doc_id != 2)
    assert kept == [(3, ""), (5, "a b c d e f g")]


def test_one_of_each_keeps_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", 7), (2, "a b c", 8)], "doc_id long, text string, component int")
    assert [tuple(r) for r in ngram_join.one_of_each(df).collect()] == [(1, "a b c", 7)]
    assert ngram_join.one_of_each(df.limit(0)).columns == df.columns
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def brute_lines(rows):
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        gone = []
        for u, line in enumerate((text or "").split("\n")):
            s = shingles(line)
            if s:
                if any(alike(s, t) for t in seen):
                    gone.append(u)
                seen.append(s)
        out[i] = gone
    return out


def test_line_dedup_matches_brute_force(spark):
    rows = corpus(5)
    df = table(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", removed_lines string"), 4)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    want = brute_lines(rows)
    assert {i: list(r.removed_lines) for i, r in out.items()} == want
    for i, text in rows:
        kept = None if text is None else "\n".join(x for u, x in enumerate(text.split("\n")) if u not in want[i])
        assert out[i].text == kept


def test_line_dedup_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_substring_dedup_removes_later_passages_only(spark):
    passage = "The first of many words goes here. " + "Another long sentence that repeats word for word in both texts. " * 1 + \
        "And a third one that is also quite long, so that the run has enough words."
    rows = [(1, "Own start here. " + passage + " Own end."), (2, "Other words before it. " + passage + " Other end."),
            (3, "A short one. Own end."), (4, None), (5, "")]
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [list(out[i].removed) for i in (1, 3, 4, 5)] == [[], [], [], []]
    (span,) = out[2].removed
    text = rows[1][1]
    assert passage.lower().strip(" .") in text[span.start:span.end].lower()
    assert out[2].text == text[:span.start] + text[span.end:] and "Other end" in out[2].text
    assert out[4].text is None and out[5].text == "" and out[1].text == rows[0][1]


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    sentences = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(3, 15))) + "." for _ in range(80)]
    rows = [(i, " ".join(rng.choice(sentences) for _ in range(12)).replace(". a", ".\na")) for i in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        spans, run, words = [], None, 0
        units = list(substring_dedup.units_of(t))
        for a, b, plain in [*units, (None, None, None)]:
            if plain in seen and plain is not None:
                run, words = (run[0] if run else a, b), words + len(plain.split())
            else:
                if run and words >= 20:
                    spans.append(run)
                run, words = None, 0
                if plain is not None:
                    seen.add(plain)
        want[i] = spans
    out = substring_dedup.dedup_substrings(table(spark.createDataFrame(rows, SCHEMA), 3)).collect()
    assert {r.doc_id: [tuple(s) for s in r.removed] for r in out} == want


def test_substring_dedup_removes_every_repeated_line(spark):
    notice = "All rights reserved by the holders of this short text."
    two = "Two words. Then three more."
    rows = [(i, f"own line {i} here\n{notice}\nown end {i}\n{two}\nlast {i}") for i in range(4)]
    rows += [(4, f"a new line that ends so. {notice}"), (5, f"another one ends so. Two words. And it is new"), (6, "Footer\n\nFooter")]
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(table(spark.createDataFrame(rows, SCHEMA), 3)).collect()}
    assert out[0].text == rows[0][1] and all(
        [x for x in out[i].text.split("\n") if x] == [f"own line {i} here", f"own end {i}", f"last {i}"] for i in (1, 2, 3))
    # pieces of lines that are new as a whole stay below the limit
    assert all(out[i].text == rows[i][1] for i in (4, 5)) and out[6].text.strip() == "Footer"
    short = {r.doc_id: r for r in substring_dedup.dedup_substrings(table(spark.createDataFrame(rows, SCHEMA), 3), min_words=5).collect()}
    assert notice not in short[4].text and short[5].text == rows[5][1]


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]])
def test_components(spark, links):
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = {}
    if len(links) > 2:
        want = {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert got == want


def test_sketches_pass_all_similar_sets(spark):
    rng = random.Random(9)
    texts = []
    for size in (4, 40, 300, 2500):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for share in (0, 0.01, 0.04, 0.3):
            texts.append(" ".join(f"x{rng.randrange(5000)}" if rng.random() < share else w for w in words))
    kind = setjoin.Units()
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    rows = stored(setjoin.sketches(df, kind), "sketches")
    assert {r.node: r.n for r in rows.collect()} == {i: len(shingles(t)) for i, t in enumerate(texts)}
    met = {(r.x, r.y): r.near for r in rows.alias("a").join(rows.alias("b"), F.expr("a.node < b.node")).select(
        F.col("a.node").alias("x"), F.col("b.node").alias("y"), setjoin.near_enough("a", "b", kind).alias("near")).collect()}
    similar = {(x, y) for x, y in met if alike(shingles(texts[x]), shingles(texts[y]))}
    assert similar and all(met[p] for p in similar)
    assert not all(met.values())


def test_sizes_at_the_limit_meet_across_blocks(spark):
    """Lines of 3 n and 4 n shingles, as far apart as similar sets can be, for sizes on and
    beside the edges of size blocks."""
    lines = []
    for n in (1, 3, 4, 9, 12, 16, 27, 36, 48, 64, 81, 243, 256):
        words = [f"s{n}w{j}" for j in range(4 * n + 4)]
        lines += [" ".join(words), " ".join(words[:3 * n + 4])]
    rows = list(enumerate(lines))
    out = {r.doc_id: list(r.removed_lines) for r in line_dedup.dedup_lines(table(spark.createDataFrame(rows, SCHEMA), 3)).collect()}
    assert out == brute_lines(rows) and all(out[i] == [0] for i in range(1, len(rows), 2))


def test_tables_are_dropped(spark):
    import os

    from flowlab.llm.common import Scope, drop_tables
    with Scope() as scope:
        a = stored(spark.range(5), "a")
        with Scope() as inner:
            b = stored(spark.range(5), "b")
        c = stored(spark.range(5), "c")
    places = [t._stored_at.removeprefix("file:") for t in (a, b, c)]
    assert all(os.path.isdir(p) for p in places) and len(scope.tables) == 2 and len(inner.tables) == 1
    scope.drop()
    assert [os.path.isdir(p) for p in places] == [False, True, False]
    drop_tables(b, spark.range(3))
    assert not os.path.isdir(places[1])


def random_postings(seed, n, tokens):
    rng = np.random.default_rng(seed)
    place = (rng.integers(3, 40, n) << 32) | (rng.integers(0, 6, n) << 1)
    return np.stack([rng.integers(0, tokens, n), rng.integers(-2**62, 2**62, n), place])


def as_rows(postings):
    return sorted(map(tuple, postings.T.tolist()))


@pytest.mark.parametrize("buckets", [1, 50, 408, 70_000])
def test_packed_postings_read_back(buckets):
    rows = random_postings(1, 3000, 2**setjoin.TOKEN_BITS)
    rows[2, ::7] |= 1  # dealt out by node
    packed = setjoin.in_buckets(rows, buckets)
    assert packed.bucket.is_unique and packed.bucket.between(0, buckets - 1).all()
    back = [setjoin.unpacked(b, p, buckets) for b, p in zip(packed.bucket, packed.postings)]
    assert as_rows(np.concatenate(back, axis=1)) == as_rows(rows)
    # lists that are not dealt out are whole
    whole = np.concatenate([p[0, p[2] & 1 == 0] % buckets - b for b, p in zip(packed.bucket, back)])
    assert not whole.any()


def test_only_postings_with_a_partner_are_kept():
    """Length and positional filters against all pairs of each list."""
    kind = setjoin.Units(lines=True)
    rows = random_postings(2, 3000, 900)
    lists = collections.defaultdict(list)
    for row in as_rows(rows):
        lists[row[0]].append(row)
    want = set()
    for members in lists.values():
        for i, a in enumerate(members):
            for b in members[:i]:
                na, nb = a[2] >> 32, b[2] >> 32
                left = min(na - ((a[2] & 0xFFFFFFFF) >> 1), nb - ((b[2] & 0xFFFFFFFF) >> 1))
                if 100 * min(na, nb) >= 75 * max(na, nb) and left >= kind.overlap(na, nb):
                    want |= {a, b}
    assert as_rows(setjoin.having_partners(rows, kind)) == sorted(want)
    assert 0 < len(want) < rows.shape[1]


def test_long_and_dealt_lists_are_kept_whole():
    rows = random_postings(3, setjoin.SHORT_LIST + 1, 1)
    assert as_rows(setjoin.having_partners(rows, setjoin.Units())) == as_rows(rows)
    alone = np.array([[7], [8], [(5 << 32) | 1]])
    assert as_rows(setjoin.having_partners(alone, setjoin.Units())) == as_rows(alone)
    assert setjoin.having_partners(np.empty((3, 0), np.int64), setjoin.Units()).shape == (3, 0)


def test_stored_tables_leave_no_shuffle_files(spark):
    """The setting that removes shuffle files holds while a table is written, and only then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    table = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "test")
    assert table.count() == 10 and table.agg(F.sum("count")).first()[0] == 1000
    assert tracker.shuffleStatuses().size() <= held + 2  # at most the shuffles of the two checks above
    assert spark.conf.get(name) == before


def test_word_hashes_as_defined_across_blocks():
    rng = random.Random(5)
    texts = [" \tÄ b\x0bC ".encode(), b"", b"x" * (3 * setjoin._BLOCK) + b" Y", " ".join(
        rng.choice("aBcé<") * rng.randint(1, 9) for _ in range(60_000)).encode(), b"\x0c", b"last"]

    def one(word):
        total, power = len(word), 1
        for c in word:
            total += int(setjoin._LETTER[c]) * power
            power = power * int(setjoin._BASE) % 2**64
        return total % 2**64

    found = [(w.lower(), i) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    made = {w: one(w) for w, _ in found}
    hashes, owner, tails = setjoin.hash_words_and_ends(texts)
    assert hashes.tolist() == setjoin.mix(np.array([made[w] for w, _ in found], np.uint64)).tolist()
    assert owner.tolist() == [i for _, i in found]
    assert tails.tolist() == [w[-1] * 256 + (w[-2] if len(w) > 1 else 0) for w, _ in found]


def test_word_hashes_take_no_wide_numbers_for_every_byte():
    text = b"shingle " * (1 << 17)
    setjoin.hash_words([text])
    tracemalloc.start()
    try:
        setjoin.hash_words([text])
        assert tracemalloc.get_traced_memory()[1] < 16 * len(text)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_levels_are_looked_up(n):
    rng = np.random.default_rng(n)
    known = np.unique(np.r_[rng.integers(0, 2**64, n, dtype=np.uint64), np.arange(min(n, 40), dtype=np.uint64) * 3])
    numbers = np.arange(len(known)) + 1
    asked = np.r_[known, known + np.uint64(1), rng.integers(0, 2**64, 100, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]
    expected = dict(zip(known.tolist(), numbers.tolist()))
    assert setjoin.Levels(known, numbers).look_up(asked).tolist() == [expected.get(x, 0) for x in asked.tolist()]


def test_membership_is_tested_without_python_workers(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in [*range(300), 7, None]], "id long, text string")
    wanted = spark.createDataFrame([(i,) for i in (3, 3, 7, 999)], "row long")
    left, marked = setjoin.among(rows, wanted, of="id"), setjoin.among(rows, wanted, of="id", mark="may")
    assert sorted(r.id for r in left.collect()) == [3, 7, 7] and left.columns == ["id", "text"]
    assert marked.columns == ["id", "text", "may"] and marked.count() == rows.count()
    assert sorted(r.id for r in marked.filter("may").collect()) == [3, 7, 7]
    assert marked.filter("not may").count() == rows.count() - 3
    assert setjoin.among(rows, wanted.limit(0), of="id", mark="may").filter("may").count() == 0
    assert "Python" not in left._jdf.queryExecution().toString() + marked._jdf.queryExecution().toString()


def test_postings_are_packed_in_bounded_parts():
    rng = np.random.default_rng(3)
    parts = [np.stack([rng.integers(0, 2**48, n), rng.integers(0, 2**40, n), (rng.integers(1, 9, n) << 32)]) for n in [setjoin.POSTINGS // 4] * 10 + [0, 1]]
    sizes, total = [], 0
    for table in setjoin.packed(iter(parts), 400):
        back = [setjoin.unpacked(b, v, 400) for b, v in zip(table.bucket.tolist(), table.postings)]
        sizes.append(sum(x.shape[1] for x in back))
        total += int(sum(x[1].sum() for x in back))
    assert sum(sizes) == sum(p.shape[1] for p in parts) and max(sizes) <= 1.5 * setjoin.POSTINGS
    assert total == int(sum(p[1].sum() for p in parts))
