"""Stems and cover density."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.stems import STOP, stem
from palimpsest.operators import stemmed
from palimpsest.views import view

PAIRS = """consigned consign consistency consist consistently consist consisting consist consolation consol consolidate consolid consolingly consol
consonant conson conspicuous conspicu conspirator conspir constable constabl constancy constanc knackeries knackeri knaves knave knavish knavish
kneaded knead knife knife knightly knight knitting knit knotted knot knowledge knowledg generate generat generously generous skis ski dying die
news news succeed succeed hopping hop hoped hope hoping hope relational relat ponies poni ties tie cries cri gas gas gaps gap kiwis kiwi by by say say
happy happi enjoy enjoy agreed agre feed feed luxuriated luxuri communism communism adjustment adjust probate probat controlling control roll roll
youth youth yes yes boyish boyish oscillators oscil activate activ digitizer digit decisiveness decis hopefulness hope formality formal""".split()


def test_stems():
    for word, want in zip(PAIRS[::2], PAIRS[1::2]):
        assert stem(word) == want, word


def covers_by_hand(places, every):
    where = {p: k for k, own in enumerate(places) for p in own}
    if not every:
        return 0.1 * len(where)
    at = sorted(where)
    full = {(i, j) for i, j in itertools.combinations_with_replacement(range(len(at)), 2) if {where[p] for p in at[i : j + 1]} == set(range(len(places)))}
    least = [(i, j) for i, j in full if not any((x, y) != (i, j) and i <= x and y <= j for x, y in full)]
    return sum(0.1 / (1 + (at[j] - at[i]) - (j - i)) for i, j in least)


def test_cover_density():
    rng = np.random.default_rng(6)
    for _ in range(200):
        k, n = int(rng.integers(1, 4)), int(rng.integers(3, 25))
        mark = rng.integers(0, k + 2, n)
        places = [np.flatnonzero(mark == j) for j in range(k)]
        if all(map(len, places)):
            for every in (True, False):
                assert stemmed.cover_density(places, every) == pytest.approx(covers_by_hand(places, every))


def test_search(spark, sf, tmp_path):
    memories = view(spark, sf, "memories")
    extra = [(10_001, "en", "Consisting of knots", "the knotted rope consists of a knot, consistently so", ["kind=Knitting"]), (10_002, "en", None, None, None), (10_003, "de", "", "Rope and ropes", [])]
    rows = memories.select("id", "agent", "concept", "content", "tags").unionByName(spark.createDataFrame(extra, "id long, agent string, concept string, content string, tags array<string>"))
    path = f"file://{tmp_path}/stems"
    stemmed.store_stemmed(rows, path, 8)
    own = {r["id"]: (r["agent"], [w for w in re.split(r"\s+", re.sub(r"[^\w]", " ", " ".join(x for x in (r["concept"], r["content"], " ".join(r["tags"]) if r["tags"] is not None else None) if x is not None)).lower()) if w]) for r in rows.collect()}
    for query, every, agents in [("knots consist", False, None), ("knots consisting", True, None), ("ropes", False, ["de"]), ("hate ration the", False, None), ("the of", False, None), ("tion ing", True, ["en"])]:
        stems = sorted({stem(w) for w in query.split() if w not in STOP})
        want = {}
        for i, (agent, words) in own.items():
            places = [[p for p, w in enumerate(words) if w not in STOP and stem(w) == s] for s in stems]
            places = [p for p in places if p]
            if places and (len(places) == len(stems) or not every) and (agents is None or agent in agents):
                want[i] = stemmed.cover_density([np.array(p) for p in places], every)
        got = {r["id"]: r["rank"] for r in stemmed.stemmed_search(spark, path, query, agents, every).collect()}
        assert got == pytest.approx(want), query
    top = stemmed.stemmed_search(spark, path, "knots", limit=1, half=0.5).first()
    assert (top["id"], top["rank"]) == (10_001, pytest.approx(0.3)) and top["score"] == pytest.approx(0.3 / 0.8)
    assert stemmed.stem_table(rows).groupBy("word").count().where("count > 1").count() == 0
    assert stemmed.stem_table(rows.limit(0)).count() == 0
