import hashlib
import math
import re

import numpy as np

from stratagraph.operators import embedding as E


def _plain(contexts, reflections=1):
    """The model, row by row: {bucket: (weight, vector)}."""
    held = {}
    for key, text in contexts:
        held.setdefault(key, set()).update(int(hashlib.md5(t.encode()).hexdigest()[:4], 16) for t in re.findall(r"[\w$]+", (text or "").lower()))
    sums, df = {}, {}
    for key, buckets in held.items():
        digest, v = hashlib.md5(key.encode()).hexdigest(), np.zeros(64, int)
        for i in range(8):
            n = int(digest[3 * i : 3 * i + 3], 16)
            v[n % 64] += 1 if n // 64 % 2 == 0 else -1
        for b in buckets:
            sums[b] = sums.get(b, 0) + v
            df[b] = df.get(b, 0) + 1
    scaled = lambda v: [math.floor(int(x) * 127 / math.sqrt((v**2).sum()) + 0.5) for x in v]
    model = {b: (math.floor(16 * math.sqrt(len(held) / df[b])), np.array(scaled(v))) for b, v in sums.items() if v.any()}
    for _ in range(reflections):
        of = {key: sum((model[b][0] * model[b][1] for b in buckets if b in model), np.zeros(64, int)) for key, buckets in held.items()}
        of = {key: np.array(scaled(v)) for key, v in of.items() if v.any()}
        again = {b: sum((of[key] for key in held if b in held[key] and key in of), np.zeros(64, int)) for b in model}
        model = {b: (model[b][0], np.array(scaled(v))) for b, v in again.items() if v.any()}
    return {b: (w, v.tolist()) for b, (w, v) in model.items()}


TEXTS = [("a", "The cat chased a mouse; the kitten slept"), ("b", "A kitten and a mouse"), ("c", "stocks fell as bonds rose"), ("d", "Bonds and yields, stocks"), ("e", None), ("e", "cat"), ("e", "cat"), ("f", ""), ("g", "über_x $y 12")]


def test_model_and_vectors_are_those_of_a_plain_version(spark):
    df = spark.createDataFrame(TEXTS, "key string, text string")
    model = E.train(df).cache()
    got = {r.bucket: (r.weight, list(r.vector)) for r in model.collect()}
    assert got == _plain(TEXTS)
    assert {r.bucket: (r.weight, list(r.vector)) for r in E.train(df, reflections=0).collect()} == _plain(TEXTS, 0)
    assert E.identity(model) == "terms@" + E.revision([(b, w, v) for b, (w, v) in got.items()])
    assert E.identity(E.train(df.repartition(7))) == E.identity(model) != E.identity(E.train(df.where("key <> 'g'")))
    asked = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(TEXTS)] + [(99, "nothing known")], "id int, text string")
    rows = {r.id: np.array(r.embedding) for r in E.embed(asked, model, ["id"]).collect()}
    assert len(rows) == len(TEXTS) + 1 and not rows[99].any() and not rows[4].any() and not rows[7].any()
    for i, (_, text) in enumerate(TEXTS):
        v = sum((np.array(got[b][1]) * got[b][0] for b in (int(hashlib.md5(t.encode()).hexdigest()[:4], 16) for t in re.findall(r"[\w$]+", (text or "").lower())) if b in got), np.zeros(64))
        assert np.allclose(rows[i], v / (np.linalg.norm(v) or 1), atol=1e-6)
    by_column = {r.id: np.array(r.v) for r in asked.select("id", E.column(model)(asked["text"]).alias("v")).collect()}
    assert all((by_column[i] == rows[i]).all() for i in rows)


def test_terms_that_share_contexts_are_near(spark):
    animals, money = ["cat", "kitten", "mouse", "paw", "fur"], ["stock", "bond", "yield", "price", "bank"]
    texts = [(f"{k}{i}", f"{g[i % 5]} {g[(i + 1 + i // 5) % 5]}") for k, g in (("a", animals), ("m", money)) for i in range(40)]
    model = E.train(spark.createDataFrame(texts, "key string, text string"))
    words = spark.createDataFrame([(w, w) for w in animals + money], "id string, text string")
    v = {r.id: np.array(r.embedding) for r in E.embed(words, model, ["id"]).collect()}
    within = [v[a] @ v[b] for g in (animals, money) for a in g for b in g if a < b]
    across = [v[a] @ v[b] for a in animals for b in money]
    assert np.mean(within) > np.mean(across) + 0.3


def test_terms_that_never_meet_come_near_through_others(spark):
    texts = [(f"a{i}", f"{('cat', 'kitten')[i % 2]} mouse fur") for i in range(20)] + [(f"m{i}", f"{('stock', 'bond')[i % 2]} yield bank") for i in range(20)]
    words = spark.createDataFrame([(w, w) for w in ("cat", "kitten", "stock", "bond")], "id string, text string")
    v = {r.id: np.array(r.embedding) for r in E.embed(words, E.train(spark.createDataFrame(texts, "key string, text string")), ["id"]).collect()}
    assert min(v["cat"] @ v["kitten"], v["stock"] @ v["bond"]) > max(v["cat"] @ v["stock"], v["kitten"] @ v["bond"]) + 0.3


def test_an_empty_corpus(spark):
    none = spark.createDataFrame([], "key string, text string")
    model = E.train(none)
    assert model.count() == 0 and E.identity(model).startswith("terms@")
    assert [sum(r.v) for r in spark.createDataFrame([("x",)], "text string").select(E.column(model)(E.F.col("text")).alias("v")).collect()] == [0.0]


def test_buckets_are_summed_within_tasks(spark):
    """Each bucket's contexts and the sum of their sign vectors, however the rows are split; a context is not spread into a row a term and sign."""
    rows = [([1, 2], [1, -2, 1]), ([2], [-64]), ([], [5]), ([65535], [3])]
    df = spark.createDataFrame(rows, "buckets array<int>, s array<int>").repartition(3)
    want = {}
    for buckets, marks in rows:
        for b in buckets:
            n, v = want.setdefault(b, (0, [0] * 64))
            for m in marks:
                v[abs(m) - 1] += 1 if m > 0 else -1
            want[b] = (n + 1, v)
    assert {r.bucket: (r.rows, r.v) for r in E._gathered(df, E._signed).collect()} == want
