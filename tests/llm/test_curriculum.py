"""The curriculum mix against a plain version, and its training order."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clickmart.llm import curriculum, queries
from tests.llm.conftest import ODD, PLAIN, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_filled(caps, weights, total):
    """Shares by weight; what a limit leaves over is shared again."""
    full, target = set(), {}
    while True:
        rest = total - sum(caps[s] for s in full)
        left = [s for s in caps if s not in full]
        target = {s: caps[s] if s in full else rest * weights[s] / sum(weights[x] for x in left) for s in caps}
        over = {s for s in left if target[s] > caps[s]}
        if not over:
            return target
        full |= over


def brute_mix(docs, weights, most=3, share=1.0):
    """[(doc_id, size, source_size, target, taken)] and for each source the copies (demand before, words) in order."""
    sources = defaultdict(list)
    for doc_id, text, source in docs:
        digest = hashlib.md5(f"{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
        sources[source].append((digest, doc_id is None, doc_id or 0, len(WORD.findall(text or ""))))
    sizes = {s: sum(d[3] for d in found) for s, found in sources.items()}
    target = water_filled({s: most * n for s, n in sizes.items()}, weights, share * sum(sizes.values()))
    rows, copies = [], defaultdict(list)
    for s, found in sources.items():
        left = [int(target[s] + 1e-9)]
        taken = [0] * len(found)
        found.sort()
        for _ in range(most):
            for i, d in enumerate(found):
                n = min(d[3], left[0])
                copies[s].append((int(target[s] + 1e-9) - left[0], n))
                taken[i] += n
                left[0] -= n
        rows += [(None if d[1] else d[2], d[3], sizes[s], round(target[s], 6), n) for d, n in zip(found, taken, strict=True)]
    return rows, copies


def result(mixed):
    return sorted(
        ((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixed.collect()), key=repr
    )


@pytest.fixture
def odd_docs(spark):
    names = ["a", "b", None, "c", "d"]
    docs = [(i, t, names[k % 5]) for k, (i, t) in enumerate(ODD)]
    docs += [(100 + k, "word " * (k % 9 + 1), "large") for k in range(3000)] + [(7000, "same row", "large")] * 50
    docs += [(8000, None, "empty"), (8001, " ", "empty")]
    return docs


def table(spark, docs):
    return spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id bigint, text string, source string, position int, before double").repartition(5)


def weights_of(docs):
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    return {s: k % 3 + 1.0 for k, s in enumerate(sources)}


def test_against_a_plain_version(spark, odd_docs):
    docs = table(spark, odd_docs)
    wanted, _ = brute_mix(odd_docs, weights_of(odd_docs))
    mixed = curriculum.mixture(docs, queries.schedules_of(docs))
    assert result(mixed) == sorted(wanted, key=repr)
    assert result(curriculum.mixture(docs.repartition(3), queries.schedules_of(docs))) == sorted(wanted, key=repr)


@pytest.mark.parametrize("share, most", [(0.1, 3), (2.5, 3), (9.0, 2)])
def test_other_sizes_of_the_mix(spark, odd_docs, share, most):
    docs = table(spark, odd_docs)
    wanted, _ = brute_mix(odd_docs, weights_of(odd_docs), most, share) if share < most else (None, None)
    found = result(curriculum.mixture(docs, queries.schedules_of(docs), share, most))
    if wanted:
        assert found == sorted(wanted, key=repr)
    else:  # more is wanted than there is
        assert all(r[4] == most * r[1] for r in found)


def integral(points, t):
    """Of a schedule of straight lines, from 0 to t, by small steps."""
    def weight(x):
        if x <= points[0][0]:
            return points[0][1]
        for (a, wa), (b, wb) in zip(points, points[1:], strict=False):
            if x <= b:
                return wa + (wb - wa) * (x - a) / (b - a)
        return points[-1][1]

    n = 2000
    return sum(weight((k + 0.5) / n * t) for k in range(n)) * t / n


@pytest.mark.parametrize(
    "points",
    [
        [(0.0, 1.0), (1.0, 1.0)],
        [(0.0, 0.0), (1.0, 2.0)],
        [(0.0, 3.0), (1.0, 0.0)],
        [(0.2, 1.0), (0.4, 0.0), (0.6, 0.0), (0.9, 5.0)],
        [(0.5, 2.0)],
    ],
)
def test_positions_invert_the_demand(spark, points):
    docs = [(k, "x " * (k % 7 + 1), "s") for k in range(300)] + [(1000 + k, "y", "t") for k in range(100)]
    schedule = spark.createDataFrame([("s", a, w) for a, w in points], "source string, at double, weight double")
    mixed = curriculum.mixture(table(spark, docs), schedule, share=1.5)
    rows = mixed.where("source = 's'").select("digest", "size", "target", F.explode("copies").alias("c")).collect()
    whole, demand = integral(points, 1.0), 0
    last = 0.0
    for r in sorted(rows, key=lambda r: (r["c"]["pass"], r["digest"])):
        position = r["c"]["position"]
        assert last <= position <= 1
        assert math.isclose(integral(points, position) / whole * r["target"], demand, abs_tol=0.01 * r["target"])
        demand, last = demand + r["c"]["words"], position
    assert demand == int(rows[0]["target"])


def test_a_source_without_weight_is_not_taken(spark):
    docs = table(spark, [(1, "a b", "s"), (2, "c d e", "t")])
    schedule = spark.createDataFrame([("s", 0.0, 0.0)], "source string, at double, weight double")
    assert result(curriculum.mixture(docs, schedule)) == [(1, 2, 2, 0.0, 0), (2, 3, 3, 5.0, 5)]


def test_training_order(spark, odd_docs):
    docs = table(spark, odd_docs)
    schedules = queries.schedules_of(docs)
    ordered = curriculum.training_order(docs, schedules)
    assert ordered.columns == [*docs.columns, "position_", "pass", "words"]
    rows = ordered.collect()
    assert [r["position_"] for r in rows] == sorted(r["position_"] for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r["doc_id"]] += r["words"]
    wanted = defaultdict(int)
    for r in curriculum.mixture(docs, schedules).collect():
        wanted[r["doc_id"]] += r["taken"]
    assert {k: n for k, n in wanted.items() if n} == dict(taken)


def test_slices_and_blocks(spark, odd_docs, monkeypatch):
    """Running sums over many levels are those of one."""
    docs = table(spark, odd_docs)
    wanted = result(curriculum.mixture(docs, queries.schedules_of(docs)))
    monkeypatch.setattr(curriculum, "SLICE_ROWS", 7)
    monkeypatch.setattr(curriculum, "SLICES_PER_BLOCK", 4)
    assert result(curriculum.mixture(docs, queries.schedules_of(docs))) == wanted


def test_nothing(spark, odd_docs):
    docs = table(spark, odd_docs).where("false")
    assert curriculum.mixture(docs, queries.schedules_of(docs)).count() == 0
    assert curriculum.training_order(docs, queries.schedules_of(docs)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = queries.curriculum_query(spark, PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_registered(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{PLAIN}/documents.parquet").select("doc_id", "text", "source").collect()]
    wanted, _ = brute_mix(rows, weights_of(rows))
    found = queries.queries()["op11_curriculum_mix"](spark, PLAIN)
    assert result(found) == sorted(wanted, key=repr)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken", "first_place"]
    assert rows_of(found, "*") == rows_of(queries.queries()["op11_curriculum_mix"](spark, PLAIN), "*")
