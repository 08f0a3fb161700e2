"""Operators against their definitions, on hostile random streams: ties, missing times,
time that goes backwards, gapped ids."""

import itertools
import random

import pytest

from strideq import Corpus, CorpusSpec, Engine


def stream(seed, n=60):
    r = random.Random(seed)
    rows, t = [], 1000
    for i in range(n):
        t += r.choice([0, 0, 1, 2, 7]) - r.choice([0, 0, 0, 3])
        rows.append({"p": i, "id": 3 * i + 1, "user": r.choice(["a", "b", "c", None]), "kind": r.choice("XYZ"), "t": None if r.random() < 0.1 else t * 1_000_000})
    return rows


def make(spark, rows):
    df = spark.createDataFrame([(x["p"], x["id"], x["user"], x["kind"], None if x["t"] is None else x["t"] // 1_000_000) for x in rows], "position bigint, id bigint, user string, kind string, timestamp bigint")
    return Engine(Corpus(df, CorpusSpec(quantifier_ceiling=3)))


def near(rows, left, right, axis, w, forward, ok=lambda a, b: True):
    found = {}
    for a in left:
        if a[axis] is None:
            continue
        d = lambda b: b[axis] - a[axis] if forward else a[axis] - b[axis]  # noqa: B023, E731
        c = [b for b in right if b[axis] is not None and 0 < d(b) <= w and ok(a, b)]
        if c:
            found[a["p"]] = min(c, key=lambda b: (d(b), b["p"] if forward else -b["p"]))
    return found


SPANS = [("p", 1, "INWINDOW 1"), ("p", 4, "INWINDOW 4"), ("t", 3_000_000, "DURING 3 seconds"), ("t", 60_000_000, "DURING 1 minute")]


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    rows = stream(request.param)
    return rows, make(spark, rows)


def ids(e, q):
    return sorted(e.execute(q).groups)


@pytest.mark.parametrize("axis,w,text", SPANS)
@pytest.mark.parametrize("forward", [True, False])
def test_links(case, axis, w, text, forward):
    rows, e = case
    xs, ys = [r for r in rows if r["kind"] == "X"], [r for r in rows if r["kind"] == "Y"]
    op = "FOLLOWED_BY" if forward else "PRECEDED_BY"
    for more, ok in (("", lambda a, b: True), ("$u", lambda a, b: a["user"] is not None and a["user"] == b["user"]), ("!$u", lambda a, b: a["user"] is not None and b["user"] is not None and a["user"] != b["user"])):
        left = "field(kind,X)" + (" AND field(user,$u)" if more else "")
        right = "field(kind,Y)" + (f" AND field(user,{more})" if more else "")
        want = near(rows, xs, ys, axis, w, forward, ok)
        by = {r["p"]: r for r in rows}
        pairs = sorted([by[p]["id"], b["id"]] if forward else [b["id"], by[p]["id"]] for p, b in want.items())
        assert ids(e, f"SELECT {left} {op} {right} {text}") == pairs, (more, text)
        if more != "!$u":
            gone = sorted([x["id"]] for x in xs if x[axis] is not None and x["p"] not in want)
            assert ids(e, f"SELECT {left} NOT_{op} {right} {text}") == gone, (more, text)


@pytest.mark.parametrize("axis,w,text", SPANS[1:3])
def test_cooccurrence_and_quantifiers(case, axis, w, text):
    rows, e = case
    of = {k: [r for r in rows if r["kind"] == k and r[axis] is not None] for k in "XYZ"}
    sets = {tuple(sorted(x["p"] for x in c)) for c in itertools.product(of["X"], of["Y"], of["Z"]) if max(x[axis] for x in c) - min(x[axis] for x in c) <= w}
    order = lambda s: [rows[p]["id"] for p in sorted(s, key=lambda p: (rows[p][axis], p))]
    assert ids(e, f"SELECT field(kind,X), field(kind,Y), field(kind,Z) {text}") == sorted(map(order, sets))
    sets = {tuple(x["p"] for x in c) for n in (2, 3) for c in itertools.combinations(of["X"], n) if max(x[axis] for x in c) - min(x[axis] for x in c) <= w}
    assert ids(e, f"SELECT field(kind,X){{2,3}} {text}") == sorted(map(order, sets))


@pytest.mark.parametrize("axis,w,text", SPANS)
@pytest.mark.parametrize("key", [None, "user"])
def test_runs(case, axis, w, text, key):
    rows, e = case
    groups = {}
    for r in sorted((r for r in rows if r["kind"] != "Z" and r[axis] is not None and (not key or r["user"])), key=lambda r: (r[axis], r["p"])):
        own = groups.setdefault(r[key] if key else None, [])
        if own and r[axis] - own[-1][-1][axis] <= w:
            own[-1].append(r)
        else:
            own.append([r])
    want = sorted([x["id"] for x in g] for own in groups.values() for g in own if 2 <= len(g) <= 5)
    cond = "NOT field(kind,Z)" + (" AND field(user,$u)" if key else "")
    assert ids(e, f"SELECT RUN({cond}){{2,5}} {text}") == want


def test_chain_and_span(case):
    rows, e = case
    by = {r["p"]: r for r in rows}
    xs, ys, zs = ([r for r in rows if r["kind"] == k] for k in "XYZ")
    first = near(rows, xs, ys, "t", 10_000_000, True)
    want = []
    for p, b in first.items():
        n = near(rows, [b], zs, "t", 10_000_000, True)
        if n:
            c = n[b["p"]]
            if c["t"] - by[p]["t"] <= 12_000_000:
                want.append([by[p]["id"], b["id"], c["id"]])
    assert ids(e, "SELECT field(kind,X) FOLLOWED_BY field(kind,Y) FOLLOWED_BY field(kind,Z) DURING 10 seconds DURING 12 seconds") == sorted(want)


def test_group_links(case):
    rows, e = case
    xs, ys = [r for r in rows if r["kind"] == "X"], [r for r in rows if r["kind"] == "Y"]
    left = [(rows[p], b) for p, b in near(rows, xs, ys, "p", 4, True).items()]
    want, gone = [], []
    for a, b in left:
        c = [(x, y) for x, y in left if 0 < x["p"] - b["p"] <= 6]
        if c:
            at = min(x["p"] for x, _ in c)
            want += [[a["id"], b["id"], x["id"], y["id"]] for x, y in c if x["p"] == at]
        else:
            gone.append([a["id"], b["id"]])
    sub = "[field(kind,X) ~> field(kind,Y) |> within(4)]"
    assert ids(e, f"{sub} ~>(6) {sub}") == sorted(want)
    assert ids(e, f"{sub} !~>(6) {sub}") == sorted(gone)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("last", ["field(kind,X)", "field(id,*)", "field(user,$u)"])
def test_chain_of_mixed_axes(case, forward, last):
    """An event that is in the group already isn't taken again, and the next nearest is."""
    rows, e = case
    xs, ys = [r for r in rows if r["kind"] == "X"], [r for r in rows if r["kind"] == "Y"]
    op = "FOLLOWED_BY" if forward else "PRECEDED_BY"
    steps = [(ys, "p", 4), ([r for r in rows if last != "field(kind,X)" or r["kind"] == "X"], "t", 40_000_000), (rows, "p", 6)]
    want = []
    for x in xs:
        held = [x]
        for k, (right, axis, w) in enumerate(steps):
            ok = lambda a, b: b not in held and (k != 1 or last != "field(user,$u)" or x["user"] is not None and b["user"] == x["user"])  # noqa: B023, E731
            n = near(rows, [held[-1]], right, axis, w, forward, ok)
            if not n:
                break
            held.append(n[held[-1]["p"]])
        else:
            want.append([r["id"] for r in (held if forward else held[::-1])])
    assert want
    q = f"SELECT field(kind,X) AND field(user,$u) {op} field(kind,Y) INWINDOW 4 {op} {last} DURING 40 seconds {op} field(id,*) INWINDOW 6"
    assert ids(e, q) == sorted(want)


def test_chain_of_mixed_axes_makes_no_pairs(case):
    plan = case[1].plan("SELECT field(kind,X) FOLLOWED_BY field(kind,Y) INWINDOW 4 FOLLOWED_BY field(kind,Z) DURING 1 minute")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Join" not in plan


@pytest.mark.parametrize("axis,w,text", SPANS[1:3])
@pytest.mark.parametrize("legs,most", [(["not Z", "not X"], 1), (["not Z", "any", "not X"], 1), (["Y", "any"], 2)])
@pytest.mark.parametrize("key", [None, "user"])
def test_cooccurrence_of_overlapping_legs(case, axis, w, text, legs, most, key):
    """Events that could change places make one group."""
    rows, e = case
    fits = {"not Z": lambda r: r["kind"] != "Z", "not X": lambda r: r["kind"] != "X", "Y": lambda r: r["kind"] == "Y", "any": lambda r: True}
    own = [[r for r in rows if fits[x](r) and r[axis] is not None] for x in legs]
    want = set()
    for sizes in itertools.product(range(1, most + 1), repeat=len(legs)):
        for c in itertools.product(*[itertools.combinations(x, n) for x, n in zip(own, sizes, strict=True)]):
            c = [x for part in c for x in part]
            at = [x[axis] for x in c]
            if max(at) - min(at) <= w and len({x["p"] for x in c}) == len(c) and (not key or c[0]["user"] is not None and len({x["user"] for x in c}) == 1):
                want.add(tuple(sorted(x["p"] for x in c)))
    said = {"not Z": "NOT field(kind,Z)", "not X": "NOT field(kind,X)", "Y": "field(kind,Y)", "any": "field(id,*)"}
    also = " AND field(user,$u)" if key else ""
    q = ", ".join(f"({said[x]}{also})" + (f"{{1,{most}}}" if most > 1 else "") for x in legs)
    assert want
    assert ids(e, f"SELECT {q} {text}") == sorted([rows[p]["id"] for p in sorted(s, key=lambda p: (rows[p][axis], p))] for s in want)


def test_cooccurrence_exchanges_no_matches(case):
    for q in ("SELECT field(kind,X), field(kind,Y) DURING 1 minute", "SELECT field(kind,X) AND field(user,$u), field(kind,Y) AND field(user,$u) DURING 1 minute", "SELECT field(kind,X){1,2}, field(kind,Y) INWINDOW 4"):
        plan = case[1].plan(q)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "Aggregate" not in plan, q
