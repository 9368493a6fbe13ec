"""Chat windows and license scans: results, and no Python in their plans."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat, licenses


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(30):
        turn = 0
        if c % 3 == 0:
            rows.append((c, turn, "system", "Be [kind] <|end|>\n" * rnd.randint(0, 3)))
        for _ in range(rnd.randint(0, 12)):
            turn += 1
            rows.append((c, turn, rnd.choice(["user", "assistant"]), "".join(rnd.choice("ab <[^0123|\n") for _ in range(rnd.choice([0, 5, 40, 400])))))
    return rows + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 1, None, None), (99, 1, "system", "only"), (98, 1, "assistant", "x"), (98, 1, "assistant", "x")]


def plain(x):
    for a, b in (("^2", "["), ("^1", "<"), ("^0", "^")):
        x = x.replace(a, b)
    return x


@pytest.mark.parametrize("budget", [2, 60, 512])
def test_conversations_come_back(spark, budget):
    rows = conversations(budget)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "2 AS pos", "3 AS tokens")
    windows = chat.chat_windows(df, budget=budget).cache()
    got = {r.conv_id: r for r in chat.digests(chat.read_windows(windows)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        mine = sorted((t, ro or "", x or "") for i, t, ro, x in rows if i == c)
        turns = "".join(f"{ro}\n{x}\n" for _, ro, x in mine)
        loss = "".join(x for _, ro, x in mine if ro == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(mine), len(loss))
        assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for w in windows.collect():
        assert w.formatted.count("<|turn|>") == w.formatted.count("<|end|>\n") == w.n_context + w.n_new
        assert "[INST]" not in w.formatted and "</s>" not in w.formatted
        system = [x for i, _, ro, x in rows if i == w.conv_id and ro == "system"]
        if system and w.conv_id != 99:
            assert w.formatted.startswith("<|turn|>system\n")
        sizes = [max(1, -(-len(plain(x.split("\n", 1)[1])) // 4)) for x in w.formatted.split("<|end|>\n")[:-1]]
        if sum(sizes) > budget:
            assert max(sizes) > (budget - (sizes[0] if system else 0)) / 2
    windows.unpersist()


def test_chat_is_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.digests(chat.read_windows(chat.chat_windows(df)))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "Pandas" not in plan


def brute_licenses(text, templates, containment=0.8):
    """For every window of the text, retrieved or not: the best share of each template's shingles around it."""
    split = lambda t: [w for w in re.sub(r"[^\w]|_", " ", (t or "").lower()).split(" ") if w]
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    h, out = runs(split(text)), {}
    for name, notice in templates.items():
        mine = runs(split(notice))
        wanted = set(mine)
        step = licenses.STRIDE if len(mine) >= licenses.PART else 1
        for at in range(0, len(h), step):
            near = h[max(0, at - len(wanted)) :][: licenses.WINDOW + 2 * len(wanted)]
            share = len(wanted & set(near)) / len(wanted)
            if share >= containment:
                out[name] = max(out.get(name, 0), share)
    return out


def test_licenses_are_those_of_brute_force(spark):
    rnd = random.Random(6)
    filler = lambda n: " ".join(rnd.choice(["rice", "yield", "under", "the", "license", "work", "is", "licensed under the"]) + str(rnd.randint(0, 9)) for _ in range(n))
    rows = [(900, None), (901, ""), (902, "MIT"), (903, "licensed under the sun"), (None, licenses.TEMPLATES["isc"]), (None, "Released under the MIT License."), (7, "x"), (7, licenses.TEMPLATES["isc"])]
    for i, notice in enumerate(licenses.TEMPLATES.values()):
        w = notice.split()
        for k, (a, b) in enumerate([(0, 0), (3, 50), (200, 0), (17, 30), (6, 1)]):
            rows.append((100 * i + k, f"{filler(a)}\n{notice.upper() if k == 3 else notice}\n{filler(b)}"))
        for k in range(12):  # cut, changed in places, mixed with another
            v = list(w)
            for _ in range(rnd.randint(1, 1 + len(v) // 25)):
                v[rnd.randrange(len(v))] = "changed"
            a = rnd.randint(0, len(v) // 3) if k % 3 == 0 else 0
            rows.append((100 * i + 10 + k, f"{filler(rnd.randint(0, 30))} {' '.join(v[a:])} {filler(rnd.randint(0, 30))} {rnd.choice(list(licenses.TEMPLATES.values())) if k % 4 == 0 else ''}"))
        rows.append((100 * i + 7, filler(60)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "'x' AS license", "2 AS w", "3 AS row", "4 AS key")
    out = licenses.license_scan(df)
    named = lambda r: f"{r.license} {r.variant}".strip()
    got = sorted(repr((r.doc_id, named(r), round(r.containment, 9))) for r in out.collect())
    want = sorted(repr((d, n, round(c, 9))) for d, t in rows for n, c in brute_licenses(t, licenses.TEMPLATES).items())
    missed = [x for x in want if x not in got]
    assert not [x for x in got if x not in want] and len(missed) <= 0.005 * len(want) and len(want) > 250, missed
    assert all(repr((100 * i + k, n, 1.0)) in got for i, n in enumerate(licenses.TEMPLATES) for k in range(5))
    assert licenses.license_scan(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "ArrowEval" not in plan and "Pandas" not in plan
    with pytest.raises(ValueError):
        licenses.license_scan(df, {"x": "too short"})


def test_bands_collide_as_often_as_stated(spark):
    """Windows of 13 shared shingles of 18, as a copied template has at least."""
    rnd = random.Random(4)
    pairs = []
    for _ in range(600):
        common = [rnd.getrandbits(62) for _ in range(13)]
        pairs.append((common, common + [rnd.getrandbits(62) for _ in range(5)]))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    for count in (licenses.MINIMA, 3):
        m = df.select(*(licenses.window_minima(F.col(c), licenses.WINDOW, licenses.STRIDE, count).alias(c) for c in "ab"))
        equal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x[0] == y[0]), lambda same: same))
        assert abs(m.filter(equal >= licenses.ROWS).count() / 600 - licenses.collision(13 / 18, count)) < 0.06
    assert licenses.collision(13 / 18) > 0.999
