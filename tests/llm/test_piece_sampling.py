"""Sampled segmentations: their distribution, distinctness, inclusion scores and exact round trip."""

from __future__ import annotations

import math
import os
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import piece_sampling as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no vocabulary")
ODD = ["", "a", " ", "  lead", "▁own ▁▁ x", "\n\n\t", "日本語 ﬁ", "x" * 100, "\ue000 \U0001f600", "a\x00b", "².5 it's <s> </s>", "word. " * 50]


@pytest.fixture(scope="module")
def pieces():
    return P.Pieces.load()


@pytest.fixture(scope="module")
def lattices(pieces):
    return P.Lattices(pieces)


def all_ways(lattices, unit):
    edges, out = lattices.edges(unit), {}

    def walk(at, ids, w):
        if at == len(unit):
            out[tuple(ids)] = w
        else:
            for j, own, x in edges[at]:
                walk(j, [*ids, *own], w * x)

    walk(0, [], 1.0)
    total = sum(out.values())
    return {ids: w / total for ids, w in out.items()}


def test_two_best_and_their_probabilities(lattices):
    for unit in ("▁the", "▁tion", "日", "▁▁ab"):
        ways = all_ways(lattices, unit)
        lattices.add_many([unit])
        k = lattices.place[unit]
        best = sorted(ways.values(), reverse=True)[:2]
        assert np.allclose(lattices.p[k][: len(best)], best)


def test_drawing_without_the_excluded(lattices):
    unit = "▁rea"
    ways = all_ways(lattices, unit)
    noise = P.Noise("draw")
    top = sorted(ways, key=ways.get, reverse=True)
    got = Counter(lattices.draw(unit, [top[0]], noise.one)[0] for _ in range(4000))
    rest = 1 - ways[top[0]]
    assert top[0] not in got
    for t in top[1:4]:
        assert got[t] / 4000 == pytest.approx(ways[t] / rest, abs=0.03)
    assert lattices.draw(unit, list(ways), noise.one) is None


def test_samples_without_replacement():
    """First and second sample as those of drawing without replacement; perturbed values fall; none repeats."""
    lattices = P.Lattices(P.Pieces.load(sharpness=0.5))
    text = "rea on"
    a, b = (all_ways(lattices, u) for u in P.units_of(text))
    joint = {x + y: p * q for x, p in a.items() for y, q in b.items()}
    first, second = Counter(), Counter()
    n = 4000
    for i in range(n):
        got = P.top_k(text, lattices, i, 4)
        ids = [tuple(g[0].tolist()) for g in got]
        assert len(set(ids)) == len(ids) and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        assert all(math.exp(g[1]) == pytest.approx(joint[x]) and 0 < g[3] <= 1 for g, x in zip(got, ids, strict=True))
        first[ids[0]] += 1
        second[ids[1]] += 1
    for t in sorted(joint, key=joint.get, reverse=True)[:4]:
        assert first[t] / n == pytest.approx(joint[t], abs=0.03)
        assert second[t] / n == pytest.approx(sum(joint[x] * joint[t] / (1 - joint[x]) for x in joint if x != t), abs=0.03)


def test_inclusion_scores_weigh_to_one():
    """Horvitz-Thompson: the sampled probabilities over their inclusion scores add up to 1 on average."""
    lattices = P.Lattices(P.Pieces.load(sharpness=0.5))
    sums = [sum(math.exp(lp) / inc for _, lp, _, inc in P.top_k("rea on", lattices, f"ht{i}", 3)) for i in range(3000)]
    assert np.mean(sums) == pytest.approx(1, abs=0.05)


def test_all_of_a_small_lattice(lattices):
    ways = all_ways(lattices, P.units_of("on")[0])
    got = P.top_k("on", lattices, "x", 1000)
    assert len(got) == len(ways) and all(g[3] == 1 for g in got)


@pytest.mark.parametrize("text", ODD)
def test_round_trip(pieces, lattices, text):
    for ids, *_ in P.top_k(text, lattices, "k", 5):
        assert P.decode(ids, pieces.spelled) == text


def test_forgetting_changes_nothing(pieces):
    texts = [f"some words {i} here and{i % 7} there" for i in range(200)]
    run = lambda lattices: [[tuple(g[0].tolist()) for g in P.top_k(t, lattices, t, 2)] for t in texts]
    want = run(P.Lattices(pieces))
    def run(lattices):
        out = []
        for t in texts:
            lattices.forget_if_full()
            out.append([tuple(g[0].tolist()) for g in P.top_k(t, lattices, t, 2)])
        return out

    assert run(P.Lattices(pieces, 20)) == want


def test_encode_rows(spark, pieces):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (0, ""), (5, ODD[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sample": F.lit("clash"), "ids": F.lit(1)})
    got = P.encode(docs, pieces, k=3, check=True)
    assert got.filter("not exact").isEmpty()
    assert got.filter("sample = 0").count() == len(rows)
    back = {(r.doc_id, r.text) for r in P.decoded(got.filter("sample = 0"), pieces).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert sorted(map(str, got.collect())) == sorted(map(str, P.encode(docs.repartition(5), pieces, k=3, check=True).collect()))
    assert P.encode(docs.limit(0), pieces).count() == 0


def test_many_units_at_once_are_as_one_by_one(pieces):
    units = sorted({u for t in [*ODD, "Several more words, unbelievably long ones too: antidisestablishmentarianism 12345"] for u in P.units_of(t)})
    one, many = P.Lattices(pieces), P.Lattices(pieces)
    many.add_many(units)
    for u in units:
        one.add(u)
        a, b = one.place[u], many.place[u]
        assert np.allclose(one.p[a], many.p[b], rtol=1e-12)
        ids = lambda x, k: [tuple(x.buffer[o : o + n].tolist()) for o, n in zip(x.off[k], x.size[k], strict=True)]
        assert ids(one, a)[0] == ids(many, b)[0] and (ids(one, a) == ids(many, b) or one.p[a][0] == one.p[a][1])


def test_walks_follow_the_lattice(lattices):
    """The intervals share [0, 1) by the segmentations' probabilities, and each number walks to the one it lies in."""
    for unit in ("▁rea", "▁tion", "▁▁ab", "n"):
        lattices.add_many([unit])
        k = np.array([lattices.place[unit]])
        ways = all_ways(lattices, unit)
        begins = {ids: lattices.begins(k)[0, r] for r, ids in enumerate(sorted(ways, key=ways.get, reverse=True)[:2]) if len(ways) > 1}
        v = (np.arange(4000) + 0.5) / 4000
        offs, sizes, logs, low = lattices.walk(np.repeat(k, 4000), v)
        got = [tuple(lattices.buffer[o : o + s].tolist()) for o, s in zip(offs, sizes, strict=True)]
        assert np.allclose(np.exp(logs), [ways[ids] for ids in got])
        for ids, n in Counter(got).items():
            assert n == pytest.approx(4000 * ways[ids], abs=1.01)
        assert all(low[i] <= v[i] and (got[i] not in begins or low[i] == begins[got[i]]) for i in range(4000))


def test_new_chunks_are_looked_up_together(pieces, monkeypatch):
    """Ids of a round are spelled once for all texts, and a repeated new chunk is cut into units once."""
    cut, joined = [], []
    real_units, real_ragged = P._units, P.ragged
    monkeypatch.setattr(P, "_units", lambda c: cut.append(c) or real_units(c))
    fresh = P.Lattices(pieces)
    texts = [f"some words, no{k % 3} some" for k in range(40)]
    search = P.Search(texts, list(range(40)), [3] * 40, fresh)
    assert len(cut) == len(set(cut)) and len(fresh.chunk) == len(set(cut)) == len(fresh.chunk_ends) - 1
    search.run()
    monkeypatch.setattr(P, "ragged", lambda offs, sizes: joined.append(1) or real_ragged(offs, sizes))
    found = list(map(search.found, range(40)))
    assert len(joined) == len(search.samples)
    assert all(P.decode(ids, pieces.spelled) == t for t, ways in zip(texts, found, strict=True) for ids, *_ in ways)


def test_many_texts_are_as_one_by_one(pieces):
    texts = [*ODD, "rea on", "Several unbelievably long words\nin two lines", "rea on", "=" * 60 + " rea"]
    one, many = P.Lattices(pieces), P.Lattices(pieces)
    keys, ks = [P.key_of(i) for i in range(len(texts))], [3 + i % 4 for i in range(len(texts))]
    flat = lambda found: [(tuple(g[0].tolist()), *(round(x, 9) for x in g[1:])) for g in found]
    want = [flat(P.top_k(t, one, i, k)) for i, (t, k) in enumerate(zip(texts, ks, strict=True))]
    assert [flat(f) for f in P.top_k_many(texts, keys, ks, many)] == want


@pytest.mark.parametrize("text", [*ODD, "a b\nc d", "a  b", "\n x", "x \ny", "end "])
def test_chunks_hold_the_units(text):
    marked = P.BLANK + text.replace(P.BLANK, P.OWN_BLANK).replace(" ", P.BLANK) if text else ""
    assert P.units_of(text) == P._units(marked)


@pytest.mark.parametrize("text", ["=" * 60, "internationalization" * 3, "-" * 60])
def test_a_long_unit_has_its_full_lattice(pieces, lattices, text):
    """Against exact sums over all segmentations; some piece lies across character 24."""
    unit = P.BLANK + text
    assert P.units_of(text) == [unit]
    total, best = [Fraction(1)] + [Fraction(0)] * len(unit), [Fraction(1)] + [Fraction(0)] * len(unit)
    weight, size = {}, {}
    for i in range(len(unit)):
        for j in range(i + 1, min(len(unit), i + lattices.longest_piece) + 1):
            if unit[i:j] in pieces.ids:
                k, w = pieces.ids[unit[i:j]]
                weight[k], size[k] = Fraction(w) / Fraction(P.SCALE) ** (j - i), j - i
                total[j] += total[i] * weight[k]
                best[j] = max(best[j], best[i] * weight[k])
    lattices.add_many([unit])
    assert lattices.p[lattices.place[unit]][0] == pytest.approx(float(best[-1] / total[-1]))
    across = False
    for s in range(40):
        got = P.top_k(text, lattices, s, 3)
        assert len({tuple(g[0].tolist()) for g in got}) == 3
        for ids, log_p, *_ in got:
            assert math.exp(log_p) == pytest.approx(float(math.prod(weight[k] for k in ids.tolist()) / total[-1]))
            across |= 24 not in np.cumsum([size[k] for k in ids.tolist()])
    assert across


def test_log_probability_of_a_very_long_unit(lattices):
    for _, log_p, *_ in P.top_k("=" * 5000 + "ab" * 1000, lattices, "long", 3):
        assert math.isfinite(log_p)


def test_pipeline_encodes_repeats_differently(spark):
    text = "several unbelievably long words"
    docs = spark.createDataFrame([(1, text), (2, ""), (1, text), (3, None), (2, ""), (4, "a"), (1, text)], "doc_id long, text string")
    got = corpus_pipeline.encode_pieces(spark, docs, "").collect()
    assert [r.doc_id for r in got] == [1, 2, 1, 3, 2, 4, 1]
    ids = [[tuple(s.ids) for s in r.samples] for r in got]
    assert len({x for i in (0, 2, 6) for x in ids[i]}) == 3 * P.K
    assert ids[1] == ids[3] == ids[4] == [()] and ids[5]
