import duckdb
import numpy as np
import pytest

from bracketry import queries as q
from bracketry.operators import evaluation as ev
from bracketry.operators.graph import connected_components
from bracketry.operators.passes import pieces
from bracketry.plans.grouping import group_frames
from bracketry.operators.pairs import _scored, band_pairs, linked, masked_pairs, masked_scores, pack, unpack, valid_pixels

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


#: Queries by filename, on frames from 100,000 on.
REPEATING = ["audit_rollup", "capture_key", "cluster_owner", "fixable_score", "missed_groups", "predictions_sink", "transitive_partners", "capture_key_variants", "disagreement_kinds", "exact_set_score", "matched_groups"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["frame_brightness", "fused_similarity_topk", "connected_components", "masked_zncc_scene_pairs", "run_majority_vote", "disagreement_kinds", "orphan_best_match", "tile_sobel", "anchor_match", "merge_candidates", "capture_key_variants", "chroma_chi2", "best_cut", "rank_auc", "predictions_sink", "audit_rollup"])
def test_same_as_sql(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    cur = duck.execute(q.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_same_as_sql_where_names_repeat(spark, tmp_path):
    rows = duckdb.sql(f"select * replace (case when vec_id < 20 then 2500 + vec_id else 24980 + vec_id end as vec_id) from '{DATA}/embeddings.parquet' where vec_id < 120")
    rows.write_parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    for name in REPEATING:
        cur = c.execute(q.ORACLE_SQL[name])
        cols = [x[0] for x in cur.description]
        got = [tuple(r[x] for x in cols) for r in q.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, cur.fetchall())), name


GROUPS = {"living": 3, "wide": 2, "close": 1, "bed": 3, "bed_window": 2, "bath": 2, "yard": 1, "front": 2}


@pytest.mark.parametrize(("how", "hits"), [("same", 8), ("single", 2), ("merged", 6), ("split", 7)])
def test_exact_set_score(spark, how, hits):
    files = [(f"{g}{k}", g) for g, n in GROUPS.items() for k in range(n)]
    label = {"same": lambda f, g: g, "single": lambda f, g: f, "merged": lambda f, g: "wide" if g == "close" else g, "split": lambda f, g: f if f == "living0" else g}[how]
    truth = spark.createDataFrame(files, "filename string, group_id string")
    predicted = spark.createDataFrame([(f, label(f, g)) for f, g in files], "filename string, label string")
    row = ev.exact_set_score(truth, predicted).first()
    assert (row["total"], row["matched"], row["score"]) == (8, hits, hits / 8)


def test_empty_partition(spark):
    none = spark.createDataFrame([], "filename string, group_id string")
    assert ev.exact_set_score(none, none.withColumnRenamed("group_id", "label")).first()["score"] == 0.0


def test_components_of_a_chain(spark):
    nodes = spark.range(0, 60).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 50)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(nodes, edges).collect()}
    assert got == {k: 0 if k <= 40 else k for k in range(60)}


def test_masked_scores_by_hand():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (4, 64)).astype(float), rng.integers(0, 256, (3, 64)).astype(float)
    z, n = masked_scores(x, y)
    for i in range(4):
        for j in range(3):
            m = (x[i] >= 8) & (x[i] <= 247) & (y[j] >= 8) & (y[j] <= 247)
            assert n[i, j] == m.sum() and abs(z[i, j] - np.corrcoef(x[i][m], y[j][m])[0, 1]) < 1e-6


def test_bands_find_what_the_dense_plan_finds(spark):
    f = q.frames(spark, DATA).where("scene < 40")
    dense = {(r["a"], r["b"]) for r in masked_pairs(f, 0.9, 24).collect()}
    banded = {(r["a"], r["b"]) for r in _scored(f, band_pairs(f), 0.9, 24).collect()}
    assert dense and len(banded & dense) / len(dense) > 0.99 and banded <= dense


def test_many_frames_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    one = rng.normal(size=(4100, 64))
    x = np.floor(np.clip(128 + 60 * np.concatenate([one, 0.72 * one + 0.69 * rng.normal(size=one.shape)]), 0, 255))
    want = set()
    for at in range(0, len(x), 400):
        z, n = masked_scores(x[at : at + 400], x)
        i, j = np.nonzero((z >= 0.6) & (n >= 16))
        want |= {(int(a + at), int(b)) for a, b in zip(i, j, strict=True) if a + at < b}
    f = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "frame_id long, tile array<double>")
    got = [(r["a"], r["b"]) for r in masked_pairs(f, 0.6, 16).select("a", "b").collect()]
    assert len(x) > 8000 and len(want) > 3000 and len(got) == len(set(got)) and set(got) == want


def test_grouping_recovers_scenes(spark):
    row = ev.exact_set_score(q.truth(spark, DATA), q.QUERIES["bracket_grouping"](spark, DATA)).first()
    assert row["total"] == 500 and row["score"] > 0.9


def test_curve_counts_components(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    v = np.array([r["embedding"] for r in rows], float)
    k = np.floor((np.round(v @ v.T, 9) - 0.2) * 100)

    def groups(t):
        label = np.arange(len(v))
        while True:
            new = np.where(k >= t, label[None], len(v)).min(axis=1)
            new = np.minimum(label, new)
            if (new == label).all():
                return len(set(label))
            label = new

    want = {t: groups(t) for t in range(70)}
    got = {r["id"]: r["c"] for r in q.QUERIES["component_curve"](spark, DATA).collect()}
    below = {r["id"]: r["c"] for r in q.QUERIES["count_curve"](spark, DATA).collect()}
    assert got == want and all(below[t] <= got[t] for t in got) and sum(below.values()) < sum(got.values())
    slope = {t: (want[t + 3] - want[t - 3]) / 6 for t in range(3, 67) if 2 * want[t] <= max(want.values())}
    fits = [t for t, s in slope.items() if s <= 1.3 * min(slope.values()) + 0.5]
    assert q.QUERIES["plateau_threshold"](spark, DATA).first()["threshold"] == min(fits, default=69)


def tiles_at_the_edge(seed=3):
    """Rows with all, some, few and no valid pixels, flat ones, copies and near copies at the extremes."""
    rng = np.random.default_rng(seed)
    one = rng.normal(size=(60, 64))
    x = np.concatenate([128 + 30 * one, 128 + 110 * one, 10 + 8 * one, 240 + 15 * one, 128 + 30 * (one + 0.9 * rng.normal(size=one.shape))])
    x = np.floor(np.clip(x, 0, 255))
    x[:3], x[3], x[4, :50], x[5, 1:] = 128, 0, 255, 200
    return np.concatenate([x, x[10:20]])


@pytest.mark.parametrize(("shift", "least", "overlap"), [(0, 0.58, 16), (0, 0.05, 2), (0, 0.97, 40), (0.37, 0.58, 16)])
def test_linked_is_what_all_scores_give(shift, least, overlap):
    x = tiles_at_the_edge()[6 if shift else 0 :] + shift  # scores of flat rows that are no whole numbers are noise
    v = valid_pixels(x)
    z, n = masked_scores(x, x)
    i, j = np.nonzero((z >= least) & (n >= overlap))
    got = {(a, b): (c, d) for a, b, c, d in zip(*(t.tolist() for t in linked(x, v, x, v, least, overlap)), strict=True)}
    near = {(a, b) for a, b in zip(*np.nonzero(np.abs(z - least) < 1e-9), strict=True)}
    want = {(int(a), int(b)) for a, b in zip(i, j, strict=True)}
    assert len(want) > 100 and (set(got) ^ want) <= near
    assert all(abs(z[k] - c) < 1e-9 and n[k] == d for k, (c, d) in got.items())


def test_tiles_are_packed_without_loss():
    for x in (np.arange(64.0), np.array([0.5, 255]), np.array([-1.0, 300]), np.array([np.nan, 3])):
        assert np.array_equal(unpack(pack(x)), x, equal_nan=True)
    assert len(pack(np.arange(64.0))) == 65


def test_grouping_is_components_of_all_pairs(spark):
    f = q.frames(spark, DATA).where("scene < 120")
    rows = f.orderBy("frame_id").select("filename", "tile").collect()
    z, n = masked_scores(*[np.array([r["tile"] for r in rows])] * 2)
    piece = pieces((z >= 0.70) & (n >= 24))
    got = {r["filename"]: r["label"] for r in group_frames(f).collect()}
    first = [int(np.argmax(piece == c)) for c in piece]
    assert [got[r["filename"]] for r in rows] == first and 1 < len(set(first)) < len(rows)


def grouped(n, links):
    label = list(range(n))
    while True:
        new = label[:]
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_a_forest_links_what_all_pairs_link(spark):
    rng = np.random.default_rng(5)
    x = np.floor(np.clip(128 + 60 * (np.repeat(rng.normal(size=(8, 64)), 50, axis=0) + 0.3 * rng.normal(size=(400, 64))), 0, 255))
    x = np.concatenate([x, tiles_at_the_edge()])
    f = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "frame_id long, tile array<double>")
    for least, overlap in ((0.58, 16), (0.7, 24)):
        every, some = ([(r["a"], r["b"]) for r in masked_pairs(f, least, overlap, forest=how).collect()] for how in (False, True))
        assert set(some) <= set(every) and len(some) < len(every) / 2 and grouped(len(x), some) == grouped(len(x), every)


@pytest.mark.parametrize("few", [0, 8, 1 << 17])
def test_components_of_chains_and_hubs(spark, monkeypatch, few):
    monkeypatch.setattr("bracketry.operators.graph.FEW", few)
    rng = np.random.default_rng(4)
    place = rng.permutation(200).tolist()
    links = [(place[k], place[k + 1]) for k in [*range(90), *range(92, 120)]] + [(place[130], place[k]) for k in range(131, 160)] + [(place[199], place[199]), (place[0], 999)]
    got = connected_components(spark.range(0, 200).withColumnRenamed("id", "node"), spark.createDataFrame(links, "a long, b long")).collect()
    assert [label for _, label in sorted(map(tuple, got))] == grouped(200, links[:-1])


def test_all_orphans_meet_all_other_groups(spark):
    labels, f = q.stray(spark, DATA), q.frames(spark, DATA).select("frame_id", "brightness")
    rows = {r["frame_id"]: (r["label"], r["brightness"]) for r in labels.join(f, "frame_id").collect()}
    groups = [g for g, _ in rows.values()]
    orphans = {k for k, (g, b) in rows.items() if (b < 45 or b > 210) and groups.count(g) <= 2}
    found = q.QUERIES["orphan_candidates"](spark, DATA).groupBy("frame_id").agg({"b": "count"}).collect()
    assert {r[0] for r in found} == orphans and {r[1] for r in found} == {len(set(groups)) - 1} and any(k % 50 for k in orphans)
