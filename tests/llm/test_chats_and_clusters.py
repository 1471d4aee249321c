"""Centroid clustering, the prefix trie and chat formatting against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from flowlab.llm import centroids, chat, trie
from flowlab.llm.common import stored
from flowlab.llm.queries import QUERIES, rebuilt
from tests.conftest import SF_SMALL

CHAT = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- centroid clustering ---------------------------------------------------------

def brute_clusters(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(x)) for x in v]))
    centres = [v for _, v in sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, vs in groups.items():
            centres[j] = [sum(c) // len(vs) for c in zip(*vs)]
    done = [(i, *near(v)) for i, v in kept]
    return sorted((-1 if i is None else i, j, d, sum(e for _, e, m in done if m == j), sum(e for _, e, _ in done),
                   sha(",".join(map(str, centres[j])))) for i, d, j in done)


def clusters_of(df, **options):
    out = centroids.cluster(df, **options).assigned()
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in out.collect())


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(200, 290)]  # a third are one vector
    rows += [(7, rows[7][1]), (7, [1.0] * 6), (None, [0.25] * 6)]  # repeated ids, no id
    odd = [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 5 + [None]), (504, [float("nan")] * 6), (505, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd],
                               "vec_id long, embedding array<float>, v string, near int").repartition(5)
    as_float = [(r.vec_id, r.embedding) for r in df.collect()]
    for k, rounds in ((4, 6), (8, 10), (1, 2)):
        assert clusters_of(df, k=k, rounds=rounds, dims=6) == brute_clusters(as_float, k, rounds, 6)
    # vectors whose squared distances fit in no long are left out
    assert centroids.cluster(spark.createDataFrame([(1, [1e30] * 6)], "vec_id long, embedding array<float>"), k=2, rounds=1, dims=6).centroids == []


def test_clusters_of_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [-3.0, 2.0])]
    df = spark.createDataFrame(rows, schema)
    assert clusters_of(df, k=8, rounds=3, dims=2) == brute_clusters(rows, 8, 3, 2)  # ties go to the smaller number
    assert clusters_of(df.limit(0), k=8, rounds=3, dims=2) == []


def test_empty_cluster_keeps_its_centroid(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    out = centroids.cluster(df, k=3, rounds=2, dims=1, centroids=[[0], [1024], [99999]])
    assert out.centroids == [[0], [1024], [99999]]


def test_cluster_plan_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, [0.0] * 64)], "vec_id long, embedding array<float>")
    vectors = centroids.integer_vectors(df, vector="embedding", dims=64, scale=1024, keep=["vec_id"])
    plan = centroids.nearest(vectors, [[0] * 64, [1] * 64])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- prefix trie -----------------------------------------------------------------

def brute_trie(conversations):
    """conversations: id -> list of (role, text)."""
    members = collections.defaultdict(list)
    for c in sorted(conversations):
        for d in range(len(conversations[c]) + 1):
            members[tuple(conversations[c][:d])].append(c)
    leaf, saved = collections.Counter(), collections.Counter()
    children = collections.Counter(p[:-1] for p in members if p)
    for p, ids in members.items():
        worth = (len(ids) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaf[p[:d]] += children[p] == 0
            saved[p[:d]] += worth
    return sorted((ids[0], len(p), members[p[:-1]][0] if p else -1, len(ids), children[p], leaf[p], saved[p],
                   sha(",".join(str(c) for c in ids if len(conversations[c]) == len(p)))) for p, ids in members.items())


def nodes_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def chats(seed=2):
    rng = random.Random(seed)
    texts = ["", "hi", "hello  there", "a\tb c", "long " * 50, None, " x y"]
    out = {}
    for c in range(240):
        if c % 3 == 0:  # a third are copies of one conversation
            out[c] = [("user", "hot first turn"), ("assistant", "same answer")]
        else:
            out[c] = [(rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(rng.randrange(1, 6))]
    out[500] = [("user", "deep")] * 300
    out[501] = [("user", "deep")] * 290 + [("user", "other")]
    return out


def table(spark, conversations):
    rows = [(c, t, r, x, "extra", 3) for c, turns in conversations.items() for t, (r, x) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, CHAT + ", path string, words int").repartition(6)


def plain(conversations):
    return {c: [(r or "", x or "") for r, x in turns] for c, turns in conversations.items()}


def test_trie_equals_brute_force_however_sharded(spark, monkeypatch):
    given = chats()
    paths = stored(trie.sequences(table(spark, given)), "paths")
    want = brute_trie(plain(given))
    for shards, piece in ((1, 4096), (2, 7), (5, 1), (40, 3), (None, 4096)):  # copies span shards and pieces
        monkeypatch.setattr(trie, "ENDS", piece)
        out = trie.prefix_trie(paths, shards=shards)
        assert nodes_of(out) == want, shards
        # parents by name agree with parents by smallest member
        up = out.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("p"), F.col("depth").alias("pd"))
        assert out.join(up, ["up_hi", "up_lo"]).filter("p = parent_conv_id and depth = pd + 1").count() == len(want) - 1


def test_trie_of_turnless_and_missing(spark):
    paths = spark.createDataFrame([(4, [], []), (2, [5], [3]), (9, [], []), (3, [5], [3])], "conv_id long, path array<long>, words array<long>")
    assert nodes_of(trie.prefix_trie(paths)) == [(2, 0, -1, 4, 1, 1, 3, sha("4,9")), (2, 1, 2, 2, 0, 1, 3, sha("2,3"))]
    assert nodes_of(trie.prefix_trie(paths.limit(0))) == []
    empty = spark.createDataFrame([], CHAT)
    assert trie.sequences(empty).count() == 0


def test_turns_in_order_and_rebuilt(spark):
    rows = [(20, 3, "user", "d"), (20, None, "system", "a"), (20, 1, "user", "b"), (None, 0, "user", "lost"),
            (21, 0, "user", "x"), (21, 1, None, None), (21, 1, None, None), (33, 5, "user", "only"), (45, 0, "user", "no donor"), (45, 1, "user", "y")]
    df = spark.createDataFrame(rows, CHAT)
    given = {20: [("system", "a"), ("user", "b"), ("user", "d")], 21: [("user", "x"), ("", ""), ("", "")],
             33: [("user", "only")], 45: [("user", "no donor"), ("user", "y")]}
    assert nodes_of(trie.prefix_trie(trie.sequences(df))) == brute_trie(given)
    after = {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        after[c] = given.get(c - c % 20, [])[:h] + turns[h:]
    assert any(after[c] != given[c] for c in after)
    assert nodes_of(trie.prefix_trie(rebuilt(trie.sequences(df)))) == brute_trie(after)


def test_medians_and_tree_order():
    assert sorted(trie.medians(10)) == list(range(10)) and next(trie.medians(9)) == 4
    rng = random.Random(3)
    paths = sorted({tuple(rng.randrange(9) for _ in range(rng.randrange(6))) for _ in range(400)})
    tree = trie.Tree()
    for m in trie.medians(len(paths)):
        tree.insert(list(paths[m]), [1] * len(paths[m]), m)
    order, parent = tree.traverse()
    assert [tree.ends[n] for n in order if tree.ends[n] >= 0] == list(range(len(paths)))
    assert len(order) == len({p[:d] for p in paths for d in range(len(p) + 1)}) and all(parent[n] < n for n in order[1:])


# --- chat formatting -------------------------------------------------------------

PIECES = ["\\", "\\\\", "#", "##", "###", "####", "### User: ", "### Assistant: ", "</turn>", "</turn", "<", "/turn>", "<\\/turn>", "\n", " ", "ok", ": ", "=",
          "😀", "$1", "", "#\\##", "\\n"]


def formatted_by_hand(turns):
    out = ""
    for role, text in turns:
        label = {"system": "System", "user": "User", "assistant": "Assistant"}.get(role) or "=" + role.encode().hex().upper()
        text = text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>")
        text = "".join(ch + ("\\" if text[i:i + 3] == "###" else "") for i, ch in enumerate(text))
        out += f"### {label}: {text}</turn>\n"
    return out


def test_chats_read_back_as_they_were(spark):
    rng = random.Random(4)
    given = {c: [(rng.choice(["system", "user", "assistant", "tool", "User", None, "a: b</turn>"]),
                  rng.choice([None, "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))])) for _ in range(rng.randrange(1, 6))]
             for c in range(300)}
    given[400] = [("user", "x " * 200000 + "\\" * 5000), ("assistant", "<" * 5000 + "#" * 5000)]  # long texts
    out = chat.format_chats(table(spark, given))
    rows = out.select("conv_id", "formatted", "n_turns", chat.read_back(F.col("formatted")).alias("turns"),
                      chat.learned_text(F.col("segments")).alias("learned"), F.array_join("segments.text", "").alias("joined")).collect()
    want = plain(given)
    assert len(rows) == len(given)
    for r in rows:
        turns = want[r.conv_id]
        assert [tuple(t) for t in r.turns] == turns and r.n_turns == len(turns)
        assert r.formatted == r.joined == formatted_by_hand(turns)
        assert r.learned == "".join(x for role, x in turns if role == "assistant")
        assert r.formatted.count("</turn>") == len(turns) and r.formatted.count("###") == len(turns)


def test_machine_names_the_first_turn_out_of_order(spark):
    cases = {1: (["system", "user", "assistant"], True, None), 2: (["user", "assistant", "user", "assistant"], True, None),
             3: (["user"], False, None), 4: (["assistant"], False, 0), 5: (["user", "user", "assistant"], False, 1),
             6: (["user", "assistant", "system", "user"], False, 2), 7: (["user", "tool", "assistant"], False, 1), 8: ([None], False, 0),
             9: (["user", "error"], False, 1), 10: (["start user"], False, 0)}
    out = chat.format_chats(table(spark, {c: [(r, "x") for r in roles] for c, (roles, _, _) in cases.items()}))
    got = {r.conv_id: (r.valid, r.bad_turn) for r in out.collect()}
    assert got == {c: (valid, bad) for c, (_, valid, bad) in cases.items()}


def test_another_template(spark):
    t = chat.Template(roles={"q": chat.Role("Q"), "a": chat.Role("A", loss=True)}, moves={"start": ("q",), "q": ("a", "q")},
                      final=("a", "q"), mark="<|", colon="|> ", footer="[end]", gap="")
    given = {1: [("q", "<|A|> [end] \\"), ("a", "[[end]<<|")]}
    row = chat.format_chats(table(spark, given), t).select("*", chat.read_back(F.col("formatted"), t).alias("turns")).first()
    assert [tuple(x) for x in row.turns] == given[1] and row.valid
    assert row.formatted == "<|Q|> <\\|A|> [\\end] \\\\[end]<|A|> [[\\end]<<\\|[end]"


def test_chat_ties_nulls_and_empty_table(spark):
    rows = [(None, 0, "user", "no id"), (1, 1, "user", "b"), (1, None, "user", "first"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, None, None)]
    out = chat.format_chats(spark.createDataFrame(rows, CHAT).repartition(3))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {None: [("user", "no id")], 1: [("user", x) for x in ("first", "a", "a", "b")], 2: [("", "")]}
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_query_runs_on_native_expressions(spark):
    df = QUERIES["op13_chat_formatting"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    probe = df.filter("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert (probe.n_turns, probe.loss_chars, probe.valid) == (2, len(text), True)
    assert probe.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n") and probe.loss_sha256 == sha(text)
