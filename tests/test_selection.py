"""Blends searched pair by pair in one job, and the final selection built on them."""

import random

import pytest

from rankspark.operators import decisions as D
from rankspark.operators import fusion as B
from rankspark.operators import metrics as M
from tests.conftest import rows

SCORE = "model_id string, row_id bigint, user_id int, label int, score double, date int"


@pytest.fixture(scope="module")
def packs(spark):
    """Two seeds each of three identities: `left` knows the order of one kind of row, `right` of the other, `weak` of neither."""
    rng = random.Random(3)
    out, n = [], 0
    for user in range(80):
        for place in range(10):
            label, kind = int(rng.random() < 0.4), place % 2
            for model, knows in (("l0", 0), ("l1", 0), ("r0", 1), ("r1", 1), ("w0", 2), ("w1", 2)):
                signal = 2.0 * label - 1.0 if knows == kind else 0.0
                out.append((model, n, user, label, signal + 0.4 * rng.random(), 20240101 + n % 9))
            n += 1
    return spark.createDataFrame(out, SCORE).repartition(4).cache()


def members_of(spark, configs):
    named = [(f"{i[0]}{s}", i, c, p) for i, (c, p) in configs.items() for s in (0, 1)]
    return spark.createDataFrame(named, "model_id string, identity string, config map<string,string>, primary double")


CONFIGS = {"left": ({"k": "16"}, 0.7), "right": ({"k": "8"}, 0.69), "weak": ({"k": "32"}, 0.5)}


def test_all_pairs_at_once_equal_each_alone(spark, packs):
    pairs = [("l0", "r0"), ("l0", "w0"), ("w0", "r1")]
    table = spark.createDataFrame([(f"{a}+{b}", a, b) for a, b in pairs], "pair string, left_id string, right_id string")
    got = {r.pair: r for r in B.search_pairs(packs, table, replicates=40).collect()}
    assert len(got) == 3
    for a, b in pairs:
        sides = B.pair_scores(packs, a, b)
        point = B.sweep_blend(sides).first()
        mixed = B.apply_blend(sides, point.blend_alpha, point.blend_gamma).selectExpr("'blend' AS model_id", "*")
        base = sides.selectExpr("'bag' AS model_id", "row_id", "user_id", "label", "date", "s_a AS score")
        boot = M.paired_bootstrap(M.paired_users(M.user_metrics(mixed.unionByName(base)), "bag"), 40).first()
        halves = M.half_primaries(mixed).first()
        r = got[f"{a}+{b}"]
        assert (r.blend_alpha, r.blend_gamma) == (point.blend_alpha, point.blend_gamma)
        assert r.blend_primary == pytest.approx(point.blend_primary) and r.se_val_delta == pytest.approx(boot.se_val_delta)
        assert (r.ci95_lo, r.ci95_hi) == pytest.approx((boot.ci95_lo, boot.ci95_hi))
        assert r.robust == pytest.approx(min(halves.primary_front, halves.primary_back))


def test_a_blend_wins(spark, packs):
    members = members_of(spark, CONFIGS)
    cands = {r.candidate: r for r in D.final_candidates(packs, members).collect()}
    bags = {c: r for c, r in cands.items() if r.kind == "bag"}
    assert sorted(bags) == ["left", "right", "weak"]
    top = max(bags, key=lambda c: bags[c].score)
    other = "right" if top == "left" else "left"
    blend = cands[f"{top}+{other}"]
    assert blend.kind == "blend" and blend.score > bags[top].score + 0.1
    final = D.pick_final(packs, members).first()
    assert final.candidate == f"{top}+{other}" and final.robust == pytest.approx(blend.robust)
    found = B.complementary_blend(packs, members, replicates=60).first()
    assert found.best_identity == "left" and found.partner in ("right", "weak") and found.ci95_lo <= found.ci95_hi
    two = members.where("identity <> 'weak'")
    won = B.complementary_blend(packs, two, replicates=60).first()
    assert won.partner == "right" and won.accepted and won.blend_alpha > 0 and won.blend_primary > won.bag_primary


def test_leaky_pairs_and_lone_identities_make_no_blend(spark, packs):
    leaky = {i: ({**c, "use_time_decay": "true"}, p) for i, (c, p) in CONFIGS.items()}
    assert {r.kind for r in D.final_candidates(packs, members_of(spark, leaky)).collect()} == {"bag"}
    alone = members_of(spark, {"left": CONFIGS["left"]})
    assert [r.candidate for r in D.final_candidates(packs, alone).collect()] == ["left"]
    assert B.complementary_blend(packs, alone).collect() == []


def test_ensemble_nodes_are_candidates(spark, packs):
    nodes = [("r", 1, "ensemble", 0.9, False, "same_config", None, {"k": "8"}), ("r", 2, "ensemble", 1.5, False, "complementary", 0.001, {"k": "16"}),
             ("r", 3, "ensemble", 1.5, False, "complementary", 0.4, {"k": "16"}), ("r", 4, "ensemble", None, False, None, None, {}), ("r", 5, "draft", 1.5, False, None, None, {}),
             ("r", 6, "ensemble", 1.5, True, None, None, {})]
    ledger = spark.createDataFrame(
        [(*n, None) for n in nodes],
        "run_id string, node_id int, stage string, primary double, is_skip boolean, ensemble_kind string, se_val_delta double, config map<string,string>, members array<int>",
    )
    members = members_of(spark, CONFIGS)
    got = D.final_candidates(packs, members, ledger).where("kind = 'node'")
    assert rows(got, "candidate", "score", "n_flags") == [("1", 0.9, 1), ("2", 1.5, 0)]
    assert D.pick_final(packs, members, ledger=ledger).first().candidate == "2"


def test_jobs_do_not_follow_the_number_of_pairs(spark, packs):
    def jobs(pairs):
        tag = f"pairs-{len(pairs)}"
        spark.sparkContext.setJobGroup(tag, tag)
        table = spark.createDataFrame([(a + b, a, b) for a, b in pairs], "pair string, left_id string, right_id string")
        B.search_pairs(packs, table, replicates=20, chunked=False).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))

    one, many = jobs([("l0", "r0")]), jobs([(a, b) for a in ("l0", "l1", "w0") for b in ("r0", "r1", "w1")])
    assert many <= one + 6  # adaptive stages may count one job more or less


def test_greedy_choice_by_rounds(spark):
    """Rounds over the graph of close pairs give the sequential rule's choice: random graphs, a path, a star, pairs given the wrong way round."""
    rng = random.Random(9)
    graphs = [[(i, j) for i in range(14) for j in range(i + 1, 14) if rng.random() < p] for p in (0.1, 0.3, 0.8)]
    graphs += [[(i, i + 1) for i in range(13)], [(0, i) for i in range(1, 14)], [(i, 13) for i in range(13)], [], [(5, 2), (2, 5), (5, 2)]]
    models = [f"m{i}" for i in range(14)]
    for graph in graphs:
        kept = []
        close = {(i, j) for i, j in graph if i < j}
        for j in range(14):
            if not any((i, j) in close for i in kept):
                kept.append(j)
        pairs = spark.createDataFrame([(f"m{i}", f"m{j}") for i, j in graph], "left_id string, right_id string")
        got = {r.model_id: r.kept for r in B.keep_distinct(pairs, models).collect()}
        assert got == {f"m{i}": i in kept for i in range(14)}


def test_correlations_of_all_pairs(packs):
    models = ["l0", "r0", "w0", "l1"]
    got = {(r.left_id, r.right_id): r.spearman for r in B.model_correlations(packs, models).collect()}
    assert len(got) == 6
    for i, m in enumerate(models[:-1]):
        alone = {r.model_id: r.spearman for r in M.spearman(packs.where(B.F.col("model_id").isin(models[i:])), m).collect()}
        assert all(got[m, x] == pytest.approx(alone[x]) for x in models[i + 1 :])


def test_written_dictionaries(spark):
    from rankspark.functions import scalars as E

    cases = {
        "x {'k': 16, 'loss': 'bpr'} y": {"k": "16", "loss": '"bpr"'}, '{"note": "it\'s True", "k": 8}': {"note": '"it\'s True"', "k": "8"},
        "{'note': 'None left', 'a': True}": {"note": '"None left"', "a": "true"}, "{'it\\'s': 1}": {"it's": "1"}, "{'a': False} {'c': 2}": {"a": "false"},
        "none": None, "{'k': 1": None, "{bad}": None,
    }
    table = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.p for r in table.select("t", E.literal_patch("t").alias("p")).collect()} == cases
