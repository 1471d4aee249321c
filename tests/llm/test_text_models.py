"""BPE, packing, PII, toxicity, LM scoring, embeddings and winnowing."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import bpe, embedding_dedup, lm, packing, pii, toxicity, winnowing
from flowlab.llm.queries import word_bpe_path

from flowlab.llm.common import stored

SCHEMA = "doc_id long, text string"


def table(df, parts):
    """As a stored table of several files, the form that the operators take."""
    return stored(df.repartition(parts), "test")
TEXTS = [None, "", "  ", "Hello, world! It's we'll I'D", "<|endoftext|> hi <|startoftext|>x", "日本語テキスト 123 ٣٤ ½", "İstanbul ǅ ß ſ Å",
         "a\x1cb\x85c d\xa0e", "emoji 😀😀 ☃ 𝒳", "aaaaaaaaaaaaaaaaaaaaaaaa hahahahaha", "x" * 300, "!!!!....????" * 20, "the quick brown fox " * 900]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(word_bpe_path())


def test_bpe_matches_the_library(spark, library):
    own = bpe.SpeculativeBPE(word_bpe_path())
    rng = random.Random(1)
    texts = [*TEXTS, *("".join(rng.choice("abcdehinorst éß'1 .") for _ in range(200)) for _ in range(200))]
    for t in texts:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    assert 0 < own.merged < own.proposed
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in bpe.digests(rows, word_bpe_path()).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.decode(bpe.encode(rows, word_bpe_path()), word_bpe_path()).collect()
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in both)


def test_packing_is_whole_and_dense(spark, library):
    rng = random.Random(2)
    rows = [*enumerate(TEXTS), *((100 + i, "word " * rng.choice([1, 5, 300, 900, 2000, 5000])) for i in range(150)), (7, "twin"), (7, "twin")]
    df = table(spark.createDataFrame(rows, SCHEMA), 3)
    out = packing.pack_documents(df, word_bpe_path(), capacity=4096).collect()
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in out) == total and all(0 < r.length <= 4096 for r in out)
    by_sequence = collections.defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= math.ceil(total / 4096) + 1
    assert packing.pack_documents(df.limit(0), word_bpe_path()).count() == 0


def test_fill_respects_every_capacity():
    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(1, 60, 300))[::-1].astype(float)
    needs = np.stack([size, np.ones(300), size ** 2], 1)
    for rule in ("norm", "dot"):
        for capacity in ([100, 100, 10000], [100, 3, 10000], [100, 100, 3000 + 600]):
            bins = packing.fill(needs, np.array(capacity, float), np.ones(3), rule)
            for d in range(3):
                assert np.bincount(bins, needs[:, d]).max() <= capacity[d] + 1e-6


@pytest.mark.parametrize("limits", [{"max_documents": 3}, {"max_attention": 5000}, {"max_documents": 4, "max_attention": 6000}])
def test_pack_on_spark_with_binding_limits(spark, limits):
    rng = random.Random(12)
    rows = [(i, 0, 0, 0, rng.randint(1, 60), 0) for i in range(300)]
    parts = spark.createDataFrame(rows, packing.PIECES)

    def sequences(**given):
        met = collections.defaultdict(list)
        for r in packing.pack(parts, capacity=100, shard_pieces=100, **given).collect():
            met[r.sequence_id].append(r.length)
        assert sorted(x for m in met.values() for x in m) == sorted(r[4] for r in rows)
        return list(met.values())

    def holds(m):
        return len(m) <= limits.get("max_documents", 100) and sum(x * x for x in m) <= limits.get("max_attention", 10_000)

    bound = sequences(**limits)
    assert all(sum(m) <= 100 and holds(m) for m in bound)
    assert not all(holds(m) for m in sequences())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")),
                  "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_matches_brute_force(spark):
    rng = random.Random(4)
    pieces = ["a@b.c", "_d@e-f.g.h", "@", "1.2.3.4", "256.1.1.1", "001.02.0.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999",
              "+49", "é", "😀", "\n", " ", "1 2 3 4", "x.y", "%", "+12345678901234567", ".", "-"]
    texts = [None, "", "1 " * 20000, "a" * 30000, "a@b.c_d@e.f"] + ["".join(rng.choice(pieces) for _ in range(25)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in pii.find(df).select("doc_id", pii.spans_text(F.filter("spans", lambda s: s["kind"] != "term")).alias("s")).collect():
        assert r.s == ",".join(brute_spans(texts[r.doc_id])), texts[r.doc_id]


def brute_terms(texts):
    """Disclosing terms by counting every pair."""
    def entities(t):
        return {f"{k}:{t[a:b].lower()}" for k, a, b in (s.split(":") for s in brute_spans(t)) for a, b in [(int(a), int(b))]}

    def terms(t):
        plain = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", " ", t)
        return set("".join(c if c.isalpha() else " " for c in plain.lower()).split())

    found, told = [entities(t or "") for t in texts], [terms(t or "") for t in texts]
    seen, n = collections.Counter(e for x in found for e in x), collections.Counter(t for x in told for t in x)
    together = collections.Counter((e, t) for x, y in zip(found, told) for e in x for t in y)
    out = set()
    for (e, t), k in together.items():
        share = (k - 0.75) / n[t]
        if k > 1 and -math.log2(share) <= 1 and math.log2(share / (seen[e] / len(texts))) >= 1:
            out.add(t)
    return out


def brute_term_spans(text, disclosing):
    held = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(text)]
    for m in re.finditer(r"[^\W\d_]+", text):
        if m.group().lower() in disclosing and not any(a <= m.start() and m.end() <= b for a, b in held):
            yield m.start(), m.end()


def test_pii_terms_match_brute_force(spark):
    rng = random.Random(12)
    names = ["Quorlim", "Bez", "o", "Österby", "Tarn", "Ulf"]
    people = [(f"{x.lower().replace('ö', 'oe')}@x.org", x) for x in names] + [("10.1.2.3", "Serverhaus"), ("+49 30 1234567", "Amt")]
    common = [f"w{chr(97 + i)}" for i in range(20)]
    texts = [None, "", "no entity here, but Quorlim stands", "Bez alone\nwith wa"]
    for i in range(160):
        words = [rng.choice(common) for _ in range(8)]
        if i % 4 == 0:
            contact, name = rng.choice(people)
            words[2:2] = [name, "\n" if rng.random() < 0.5 else "", contact, f"case{i}"]
            if rng.random() < 0.2:
                words.append(rng.choice(people)[0])
        if i % 3 == 0:
            words.append("hot@all.org")  # a common entity: no common word gives it away
        if i % 31 == 0:
            words.append(rng.choice(names))
        texts.append(" ".join(words))
    texts += ["pair@x.org zwei\nzeilen weiter Kolibri", "Kolibri\n\npair@x.org", "once@x.org Einhorn", "twin@x.org lines " * 300, "twin@x.org " + "Kolibrix " * 300]
    df = table(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 5)
    disclosing = brute_terms(texts)
    assert {"kolibri", "quorlim"} <= disclosing and "einhorn" not in disclosing and not {"wa", "wb"} & disclosing
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.find(df).collect()}
    assert found == {i: list(brute_term_spans(t or "", disclosing)) for i, t in enumerate(texts)}
    assert found[2] and len(found[len(texts) - 4]) == 1  # without its entity; on another line


def test_pii_cleaning_and_clashing_columns(spark):
    rows = [(i, f"Ask Quorlim at q@x.org.\nplain words here {i}") for i in range(4)] + [(9 + i, "plain words here ask at") for i in range(20)] + [(99, None)]
    df = spark.createDataFrame([(i, t, 1, "mine") for i, t in rows], SCHEMA + ", spans int, __row string")
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[1].text == "Ask  at [EMAIL].\nplain words here 1" and clean[9].text == rows[4][1] and clean[99].text is None
    assert {r["__row"] for r in clean.values()} == {"mine"}
    assert pii.find(df.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    plain = [f"{a}{b}" for a, b in itertools.product(("ran", "tol", "mip", "sed", "kor"), ("ana", "ito", "ule", "ek"))]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grobnik", "gr0bnik", "Grоbniks", "GRÓBNIK!"])  # noqa: RUF001
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows + [(1000, None), (1001, "")], SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.filter("doc_id % 3 <> 1 or doc_id < 300"))
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((out[i] >= 0.7) == bool(y) for i, y in labels if i >= 300)
    assert out[1000] == out[1001] < 0.7
    assert toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).agg(F.max("score")).first()[0] == 0.0
    spared = toxicity.ToxicityModel(model.weights, ("grobnik cake",), model.curve)
    assert spared.features("a grobnik cake")[0] == 0.0 < spared.features("a grobnik")[0]


def test_lm_counts_base_and_gain(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        k, t = rng.randrange(40), []
        for _ in range(rng.randint(0, 60)):
            t.append(f"W{k}")
            k = (k * 7 + rng.choice([1, 2])) % 40
        rows.append((i, " ".join(t) + f" only{i}"))
    rows += [(300, None), (301, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    train = df.filter("doc_id % 7 <> 2")
    model, counts = lm.fit(train)
    out = lm.score(df, model, counts).toPandas()
    words = {i: re.findall(r"[^ \t-\r]+", (t or "").lower()) + ["\n"] for i, t in rows}
    c = collections.Counter(w for i, ws in words.items() if i % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in out.itertuples():
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    held = out[out.doc_id % 7 == 2]
    assert held.score.sum() > held.base_score.sum()
    assert lm.score(df.limit(0), model, counts).count() == 0


def test_lm_probabilities_add_up(spark):
    model, _ = lm.fit(spark.createDataFrame([(i, f"a b c{i} d e") for i in range(50)], SCHEMA))
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    targets = np.arange(lm.END + 1 + lm.RARE)
    got = model.network.log_probability(np.repeat(h, len(targets), 0), targets)
    assert np.exp(got).sum() == pytest.approx(1.0, abs=1e-3)


def test_lm_gradient():
    rng = np.random.default_rng(7)
    net = lm.Network.start(np.full(32 + lm.RARE, 1 / (32 + lm.RARE)), np.full(1024, 1 / lm.CLASS_SIZE))
    net.weights = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in net.weights.items()}
    x, y = rng.integers(0, 1030, (3, 5)), rng.integers(0, 1030, (3, 5))

    def loss():
        h, total = np.zeros((3, lm.HIDDEN)), 0.0
        for j in range(5):
            h, _ = net.step(x[:, j], h * (x[:, j] != lm.END)[:, None])
            total -= net.log_probability(h, y[:, j]).sum()
        return total / 15

    met, _ = net.gradient(x, y, np.zeros((3, lm.HIDDEN)))
    grad = {name: np.zeros_like(w) for name, w in net.weights.items()}
    for name, (rows, values) in met.items():
        grad[name][rows] = values
    plain = y[y <= lm.END]
    word = (int(plain[0]) // lm.CLASS_SIZE, int(plain[0]) % lm.CLASS_SIZE)
    unmet = next(i for i in range(1024) if i not in x)
    for name, index in (("u", (2, 5)), ("g", (20,)), ("c", (1, 3)), ("x", (int(x[0, 0]), 7)), ("x", (unmet, 7)), ("cb", (4,)),
                        ("w", (word[0], 3, word[1])), ("wb", word), ("wb", (word[0], (word[1] + 1) % lm.CLASS_SIZE))):
        w = net.weights[name]
        w[index] += 1e-4
        up = loss()
        w[index] -= 2e-4
        down = loss()
        w[index] += 1e-4
        assert grad[name][index] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5)


def test_lm_learns_from_all_rows(spark):
    """One long text early on takes no other text's place, however many rows there are."""
    rng = random.Random(11)
    first = spark.range(1700).orderBy(F.xxhash64("id")).first().id
    rows = [(i, " ".join(["left right up down"] * 20)) for i in range(1700)]
    text = rows[1][1]
    rows[first] = (first, " ".join(rng.choice("pqrs") for _ in range(320_000)))
    df = table(spark.createDataFrame(rows, SCHEMA), 4)
    model, counts = lm.fit(df)
    out = lm.score(spark.createDataFrame([(1, text)], SCHEMA), model, counts).first()
    # the words follow each other in one order only, which shares of words do not tell
    assert out.score > 0.4 * out.base_score


def test_lm_scores_texts_side_by_side_as_one_by_one():
    """Sums of log probabilities step by step, for texts of any length."""
    rng = np.random.default_rng(5)
    net = lm.Network.start(np.full(32 + lm.RARE, 1 / (32 + lm.RARE)), np.full(1024, 1 / lm.CLASS_SIZE))
    net.weights = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in net.weights.items()}
    texts = [np.r_[rng.integers(0, 1032, n), lm.END] for n in (0, 1, 5, lm.WINDOW - 1, lm.WINDOW, 3 * lm.WINDOW + 2, 0, 200)]
    got = net.score(texts)
    for text, score in zip(texts, got):
        h, last, total = np.zeros((1, lm.HIDDEN), np.float32), lm.END, 0.0
        for token in text:
            h, _ = net.step(np.array([last]), h)
            total += net.log_probability(h, np.array([token]))[0]
            last = token
        assert score == pytest.approx(total, rel=1e-4)


def lm_network(seed):
    """A network of the smallest vocabulary with weights unlike those it starts from."""
    rng = np.random.default_rng(seed)
    net = lm.Network.start(np.full(32 + lm.RARE, 1 / (32 + lm.RARE)), np.full(1024, 1 / lm.CLASS_SIZE))
    net.weights = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in net.weights.items()}
    return net, rng


def test_lm_scores_texts_of_several_chunks_together(spark, monkeypatch):
    """The steps of the recurrence follow the tokens: long texts of different chunks
    are not stepped through one after the other."""
    import pandas as pd

    net, rng = lm_network(8)
    model = lm.Model(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), 1, 2, 2, np.ones(lm.RARE), lm.END, net)
    texts = [" ".join(f"w{rng.integers(50)}" for _ in range(400 if i % 40 == 7 else 8)) for i in range(240)]
    tasks, steps, plain = [], [], lm.Network.cell
    monkeypatch.setattr(lm.Network, "cell", lambda *args: (steps.append(1), plain(*args))[1])
    monkeypatch.setattr(lm, "with_row", lambda df, name: df.withColumn(name, F.col("doc_id")))
    monkeypatch.setattr(lm, "stored", lambda df, name: tasks.append(df) or df.sparkSession.createDataFrame([], df.schema))
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda df, run, schema: (tasks.append(run), spark.createDataFrame([], schema))[1])
    lm.score(spark.createDataFrame([(1, "a")], SCHEMA), model, spark.createDataFrame([], "word long, count long"))
    run = tasks[0]
    frames = [pd.DataFrame({"row": range(a, a + 40), "text": texts[a:a + 40]}) for a in range(0, 240, 40)]
    out = pd.concat(list(run(iter(frames))))
    assert out.row.tolist() == list(range(240)) and len(steps) < 2 * 401
    alone = pd.concat([next(run(iter([pd.DataFrame({"row": [i], "text": [t]})]))) for i, t in enumerate(texts)])
    np.testing.assert_allclose(out.share, alone.share, rtol=1e-5)


def test_lm_outputs_of_any_size_and_in_any_blocks(monkeypatch):
    """Biases that exponentials cannot hold are the same softmax, and so are other blocks."""
    net, rng = lm_network(9)
    x, y = rng.integers(0, 1032, (40, 9)), rng.integers(0, 1032, (40, 9))
    h = np.zeros((40, lm.HIDDEN), np.float32)
    states, targets = np.tanh(rng.standard_normal((360, lm.HIDDEN))).astype(np.float32), y.reshape(-1)

    def results():
        grad, last = net.gradient(x, y, h)
        return [g for _, (_, g) in sorted(grad.items())] + [last, net.log_probability(states, targets)]

    want = results()
    monkeypatch.setattr(lm, "BLOCK", 64)
    for got, exact in zip(results(), want):
        np.testing.assert_allclose(got, exact, rtol=1e-3, atol=1e-6)
    for constant in (200.0, -200.0):
        moved = dict(net.weights)
        for k in ("cb", "wb"):
            net.weights[k] = moved[k] + np.float32(constant)
        for got, exact in zip(results(), want):
            np.testing.assert_allclose(got, exact, rtol=1e-2, atol=1e-4)
        net.weights = moved


@pytest.mark.parametrize("vocabulary, each", [(1023, 32), (4095, 64), (20_000, 128), (100_000, 256)])
def test_lm_classes_grow_with_the_vocabulary(vocabulary, each):
    assert lm.class_size(vocabulary) == each


def test_lm_networks_are_averaged_in_tasks(spark):
    """A round over more partitions than are averaged at once gives the mean by
    tokens of the networks that the partitions learn one by one."""
    parts = lm.TOGETHER_MODELS + 4
    df = spark.range(0, 100, 1, parts).select(
        F.col("id").alias("doc_id"), F.expr("repeat(concat('left right up w', id % 7, ' '), int(5 + id % 11))").alias("text"))
    model, _ = lm.fit(df, rates=())
    got = lm.learned(df, model, model.network, 0.01)
    rows = df.select("text", F.spark_partition_id().alias("part"), "doc_id").orderBy("doc_id").collect()
    want, total = 0.0, 0
    for part in range(parts):
        stream = [np.array([model.end])]
        for r in rows:
            if r.part == part:
                words, _, tails = lm.hash_words_and_ends([r.text.encode()])
                stream += [model.look_up(words, tails)[1], np.array([model.end])]
        own = model.network.unpacked(np.frombuffer(model.network.packed(), np.float32))
        n = own.train(iter([np.concatenate(stream)]), rate=0.01)
        want, total = want + n * np.frombuffer(own.packed(), np.float32).astype(float), total + n
    np.testing.assert_allclose(np.frombuffer(got.packed(), np.float32), want / total, atol=1e-4)
    assert len({r.part for r in rows}) == parts and got.packed() != model.network.packed()


def test_lm_vocabulary_follows_the_counts(spark):
    text = " ".join(f"w{i}" for i in range(1500))
    model, _ = lm.fit(table(spark.createDataFrame([(i, text) for i in range(lm.OFTEN)], SCHEMA), 4), rates=())
    assert model.end == model.network.end >= 1500 and (model.number >= 0).all()


def test_lm_training_covers_every_token():
    net = lm.Network.start(np.full(32 + lm.RARE, 1 / (32 + lm.RARE)), np.full(1024, 1 / lm.CLASS_SIZE))
    met, plain = set(), net.gradient
    net.gradient = lambda x, y, h: (met.update(y.ravel().tolist()), plain(x, y, h))[1]
    assert net.train(iter([np.arange(1023), np.arange(2), np.arange(1)])) == 1023
    assert met >= set(range(1, 1023))


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 64))
    x = [(base[rng.integers(60)] + 0.15 * rng.standard_normal(64)).tolist() for _ in range(500)] + [base[0].tolist()] * 30
    odd = [None, [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [1.0, 2.0], [float("inf")] * 64]
    rows = [(i, v) for i, v in enumerate(x + odd)]
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(
        table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3)).collect()}
    m = np.array(x)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    links = sum(out[i].n_links for i in range(len(x)))
    assert all(out[i].n_links <= near[i].sum() - 1 for i in range(len(x)))
    assert links >= 0.97 * (near.sum() - len(x))
    for i in range(len(x), len(rows)):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert all(out[i].component_id <= i and out[i].kept == (out[i].component_id == i) for i in out)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def recall_of_links(spark, x, **options):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = embedding_dedup.near_duplicates(table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3), **options)
    m = x / np.linalg.norm(x, axis=1)[:, None]
    near = (m @ m.T >= 0.9).sum() - len(x)
    return near, out.agg(F.sum("n_links")).first()[0] / near


def pairs_near_limit(rng, n, dim, mean, cosine=0.91):
    """Pairs of about the cosine given, around a mean of that squared length."""
    centre = np.eye(dim)[0] * math.sqrt(mean)
    x = rng.standard_normal((n, dim)) * math.sqrt((1 - mean) / dim)
    within = (cosine - mean) / (1 - mean)
    y = within * x + math.sqrt(1 - within * within) * rng.standard_normal((n, dim)) * math.sqrt((1 - mean) / dim)
    return np.concatenate([centre + x, centre + y])


@pytest.mark.parametrize("dim, mean", [(64, 0.0), (64, 0.5), (96, 0.0), (96, 0.5)])
def test_embedding_links_at_large_widths(spark, dim, mean):
    x = pairs_near_limit(np.random.default_rng(dim), 700, dim, mean)
    near, recall = recall_of_links(spark, x, width=22)
    assert near >= 500 and recall >= 0.9


def test_winnowing_guarantee_and_edits(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = [None, "", "one", "two words"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(40)] + ["twin text here now"] * 2
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in winnowing.with_edits(table(spark.createDataFrame(rows, SCHEMA), 3)).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        cut = len(t) // 3
        assert out[i].n_chars == len(t)
        assert out[i].edited_sha256 == hashlib.sha256((t[:len(t) - cut] + following[:cut]).encode()).hexdigest()
    twins = [out[i].fingerprint for i, t in rows if t == "twin text here now"]
    assert twins[0] == twins[1] and len(twins[0]) == 1
    assert out[0].fingerprint == out[3].fingerprint == []
    # a shared passage of GRAM + WINDOW - 1 words always leaves a shared hash
    passage = " ".join(rng.choice(vocabulary) for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    pair = [(1, " ".join(rng.choice(vocabulary) for _ in range(50)) + " " + passage), (2, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(50)))]
    a, b = (set(r[0]) for r in winnowing.with_fingerprint(spark.createDataFrame(pair, SCHEMA), "text", "f").select(winnowing.hashes(F.col("f"))).collect())
    assert a & b
    plan = winnowing.with_edits(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_words_are_learned_without_collections():
    """Each new word gives a list; the collector would walk through all of them time and again."""
    import gc

    store = bpe.WordStore(bpe.encoder(word_bpe_path()), packing.id_bytes)
    words = {"".join(w) for w in itertools.islice(itertools.product("aeikmnostu", repeat=5), 20_000)}
    runs = []

    def count(phase, info):
        runs.append(phase)

    gc.collect()
    gc.callbacks.append(count)
    try:
        store.meet(words)
    finally:
        gc.callbacks.remove(count)
    assert len(runs) <= 2 and gc.isenabled()
    own = bpe.SpeculativeBPE(word_bpe_path())
    assert all(store[w] == np.array(own.encode(w), "<u4").tobytes() for w in sorted(words)[:50])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000])
def test_ids_as_bytes(n):
    ids = list(range(49_000, 49_000 + n))
    assert packing.id_bytes(ids) == np.array(ids, "<u4").tobytes()


def test_language_model_tasks_give_memory_back(spark, monkeypatch):
    """Workers live on beside the executor's heap, so each task that read texts lets go of its memory."""
    import pandas as pd

    model = lm.Model(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), 1, 2, 2, np.ones(lm.RARE), lm.END, None)
    tasks, released = [], []

    class Rows:
        value, columns = model, []

        def __getattr__(self, name):
            return self

        def __call__(self, *args, **kwargs):
            return self

        def mapInPandas(self, run, schema):
            tasks.append(run)
            return self

    for name in ("small_batches", "stored", "with_row"):
        monkeypatch.setattr(lm, name, lambda df, *args: df)
    monkeypatch.setattr(lm, "release_memory", lambda *args, **kwargs: released.append(1))
    lm.word_counts(Rows())
    lm.score(Rows(), model, Rows())
    assert len(tasks) == 2
    for run in tasks:
        released.clear()
        assert len(list(run(iter([pd.DataFrame({"row": [1, 2], "text": ["a b a", None]})])))) == 1
        assert released
