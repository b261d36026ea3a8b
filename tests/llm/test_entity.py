import random

import numpy as np
import pandas as pd
import pytest

from matchloom.llm import canon, entity as E
from tests.llm.test_canon import ENTRIES

NAMES = [(e[2], e[3], e[4]) for e in ENTRIES]
COLUMNS = "map_id bigint, submission_id string, assignment_code string, answer_table string, student_table string, answer_column string, raw_student_column string, answer_type_raw string, student_type_raw string, ordinal_position int, is_nullable int"
TABLES = "map_id bigint, submission_id string, assignment_code string, raw_answer_table string, raw_student_table string, column_count int, row_count int"


def data(rng, groups=25):
    columns, tables, truth, k = [], [], set(), 0
    given = [e for e in ENTRIES if e[0] == "column"]
    for g in range(groups):
        sub = f"S{g}"
        for t in ("SinhVien", "PhieuGoiMon"):
            typed = {"SinhVien": ["Sinh viên", "pupil", "SinhVie"], "PhieuGoiMon": ["PhieuGM", "meal_ticket", "Phieesu gojimosn"]}[t]
            name = rng.choice(typed)
            k += 2
            if rng.random() < 0.5:
                tables.append((k, sub, "A", t, name, 5, 20 + g))
            else:
                tables += [(k, sub, "A", t, None, 5, 20 + g), (k + 1, sub, "A", "", name, 5, 20 + g)]
                truth.add(("table_mapping_report", k, k + 1))
        for o, e in enumerate(given):
            vi = rng.choice([e[2], e[3], canon.telex(e[3].replace(" ", ""), False), e[2].lower(), e[4].replace(" ", "_")])
            k += 2
            if rng.random() < 0.6:
                columns.append((100000 + k, sub, "A", "SinhVien", "sv", e[2], vi, "int", "int", o, 0))
            else:
                columns += [(100000 + k, sub, "A", "SinhVien", None, e[2], "", "int", None, o, 0), (100001 + k, sub, "A", None, "sv", None, vi, None, "int", o, 0)]
                truth.add(("column_mapping_report", 100000 + k, 100001 + k))
        k += 2
        columns.append((100000 + k, sub, "A", "SinhVien", "sv", None, "HobbyList", None, "text", 9, 1))
    columns.append(columns[-1][:0] + (999999, *columns[0][1:]))
    return columns, tables, truth


def write(spark, path, columns, tables, entries=ENTRIES):
    spark.createDataFrame(columns, COLUMNS).selectExpr("*", "'clash' AS side", "'clash' AS content").write.parquet(f"{path}/column_mapping_report.parquet")
    spark.createDataFrame(tables, TABLES).selectExpr("*", "'clash' AS confidence").write.parquet(f"{path}/table_mapping_report.parquet")
    spark.createDataFrame(entries, "kind string, entry_id bigint, canonical_name string, label_vi string, label_en string, known_aliases string").write.parquet(f"{path}/canonical_names.parquet")


def test_matches(spark, tmp_path):
    columns, tables, truth = data(random.Random(3))
    # an answer row exported twice: each copy counts
    report, a, s = sorted(t for t in truth if t[0] == "table_mapping_report")[0]
    twin = next(t for t in tables if t[0] == a)
    tables.append((777777, *twin[1:]))
    truth.add((report, s, 777777))
    write(spark, tmp_path, columns, tables)
    rows = E.matches(spark, str(tmp_path)).collect()
    assert all(0.3 <= r["confidence"] <= 1 for r in rows)
    found = {(r["report"], *sorted((r["student_id"], r["answer_id"]))) for r in rows}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 0.03 * len(found)
    assert (report, min(s, 777777), 777777) in found
    assert {tuple(r) for r in E.matched_rows(spark, str(tmp_path)).collect()} == found


def test_empty_and_null(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert E.matches(spark, str(tmp_path)).count() == 0
    nulls = [(1, None, None, None, None, None, None, None, None, None, None), (2, "S", None, None, None, "MaBanAn", None, None, None, None, None), (3, "S", None, None, None, None, "x" * 3000, None, None, None, None)]
    path = tmp_path / "b"
    write(spark, path, nulls, [(4, "S", None, None, None, None, None)])
    assert E.matches(spark, str(path)).count() == 0


@pytest.fixture(scope="module")
def space():
    graph = [E.side_tokens(n, None, None) + E.side_tokens(vi, None, None) + E.side_tokens(en, None, None) for n, vi, en in NAMES]
    return E.Space(graph)


def test_vectors_bring_names_together(space):
    v = lambda n: space.vector(E.side_tokens(n, None, None))
    for n, vi, en in NAMES:
        others = [v(m) for m, *_ in NAMES if m != n]
        assert v(en) @ v(n) > np.mean([v(en) @ o for o in others])
    assert np.linalg.norm(v("")) == 0 and np.linalg.norm(v(None)) == 0


@pytest.mark.parametrize("bits", [1, 2, 3, 6, 10, 12, 14, 16, 20])
def test_hyperplanes_reach_brute_force(space, bits):
    """Recall of pairs of cosine REACHED in one cell at least is 0.9 at every number of bits, and cells prune."""
    rng = random.Random(2)
    base = [n for n, *_ in NAMES]
    typed = []
    for _ in range(400):
        n = list(rng.choice(base).lower())
        n[rng.randrange(len(n))] = rng.choice("abcdefgh")
        typed.append("".join(n))
    vs = np.stack([space.vector(E.side_tokens(t, None, None)) for t in typed])
    cosine = vs @ vs.T
    pairs = [(i, j) for i in range(400) for j in range(i) if E.REACHED <= cosine[i, j] < 0.95]
    assert len(pairs) > 50
    own, visits = space.cells(vs, bits, False), space.cells(vs, bits, True)
    sets = [set(v.tolist()) for v in visits]
    hit = sum(any(c in sets[i] for c in own[j].tolist()) for i, j in pairs)
    assert hit >= 0.9 * len(pairs), (bits, hit / len(pairs))


def test_tables_grow_with_bits():
    rng = np.random.default_rng(1)
    for bits in (1, 4, 8, 12, 16, 20):
        # pairs of exactly the cosine the tables are made for, in a space of random planes
        a = rng.normal(size=(300, E.DIM))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=a.shape)
        b -= (b * a).sum(axis=1, keepdims=True) * a
        b = E.REACHED * a + (1 - E.REACHED**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
        planes = rng.normal(size=(E.tables_of(bits), bits, E.DIM))
        differ = ((np.einsum("tbd,nd->ntb", planes, a) > 0) != (np.einsum("tbd,nd->ntb", planes, b) > 0)).sum(axis=2)
        assert (differ <= 1).any(axis=1).mean() >= 0.9, bits
    assert [E.bits_of(n) for n in (0, E.LEAF, E.LEAF + 1, 4 * E.LEAF, 10**12)] == [0, 0, 1, 2, E.BITS]


def one_group(n=300):
    """One submission with n one-sided columns on each side whose names differ by a letter, and some two-sided rows of another."""
    rng = random.Random(8)
    letters = "bcdfghklmnprstvx"
    names = sorted({"".join(rng.choice(letters) for _ in range(5)) for _ in range(n)})
    columns, truth = [], set()
    for k, name in enumerate(names):
        at = 2  # in the middle, where it leaves least of the trigrams
        typed = name[:at] + rng.choice([c for c in letters if c != name[at]]) + name[at + 1 :]
        columns += [(2 * k, "big", "A", "T", None, name, None, "int", None, k, 0), (2 * k + 1, "big", "A", None, "sv", None, typed, None, "int", k, 0)]
        truth.add((2 * k, 2 * k + 1))
        columns.append((100000 + k, f"S{k // 20}", "A", "T", "sv", name[::-1], typed[::-1], "int", "int", k % 20, 0))
    return columns, truth


def test_large_group_reaches_all_pairs(spark, tmp_path, monkeypatch):
    """Blocks against all pairs, in a group cut by few and by many bits; names an edit apart all meet."""
    columns, truth = one_group()
    write(spark, tmp_path, columns, [])
    found = {}
    for leaf in (10**6, E.LEAF, 2):
        with monkeypatch.context() as m:
            m.setattr(E, "LEAF", leaf)
            found[leaf] = {(r["answer_id"], r["student_id"]) for r in E.matches(spark, str(tmp_path)).collect()}
        assert truth <= found[leaf] and len(found[leaf] & found[10**6]) >= 0.9 * len(found[10**6])


def test_all_records_of_an_object_match(spark, tmp_path):
    """Records of one column that differ in their position or type only do not compete."""
    columns, _, truth = data(random.Random(3))
    report, a, s = max(t for t in truth if t[0] == "column_mapping_report")
    row = next(c for c in columns if c[0] == s)
    columns.append((888888, *row[1:9], row[9] + 1, row[10]))
    write(spark, tmp_path, columns, [])
    found = {(r["answer_id"], r["student_id"]): r["confidence"] for r in E.matches(spark, str(tmp_path)).collect()}
    assert (a, s) in found and 0.3 <= found[a, 888888] < found[a, s]


def test_keys_of_names():
    """Names that mean one entry share a key, and so do names an edit or a doubled letter more apart."""
    names = E.Names([(e[0], *e[1:]) for e in ENTRIES])
    for _, _, given, vi, en, _ in [e for e in ENTRIES if e[0] == "column"]:
        for typed in (vi, en, given.lower()):
            assert set(names.keys("column", "s", typed)) & set(names.keys("column", "a", given))
    for typed, given in (("tonkhoo", "tonkho"), ("tonkha", "tonkho"), ("tnkhoo", "tonkho"), ("otnkhoo", "tonkho")):
        assert set(names.keys("column", "s", typed)) & set(names.keys("column", "a", given))
    assert names.keys("column", "s", "!") == [] and len(names.keys("column", "s", "x" * 3000)) == 1


def trained(spark, path, columns, entries=ENTRIES):
    write(spark, path, columns, [], entries)
    return E.train(E.records(spark, str(path)), E.known_tables(spark, str(path)), [tuple(e) for e in entries])


def words(n, letters="bcdfghkl"):
    """n distinct words of five letters."""
    return ["".join(letters[k // len(letters) ** i % len(letters)] for i in range(5)) for k in range(n)]


def test_every_record_counts(spark, tmp_path):
    """The weights of tokens come from all distinct records, however many there are, and of copies once."""
    names = words(4200)
    columns = [(k, f"S{k % 50}", "A", None, "sv", None, name, None, "int", 1, 0) for k, name in enumerate(names)]
    columns += [(10_000 + k, "copy", *c[2:]) for k, c in enumerate(columns[:100])]
    columns += [(20_000 + k, f"S{k}", "A", "SinhVien", "sv", name[::-1], name, "int", "int", 1, 0) for k, name in enumerate(names[:20])]
    entry = ENTRIES[:1]
    weights = trained(spark, tmp_path, columns, entry).space.weights
    records = [E.side_tokens(name, "int", None) for name in names]
    records += [E.side_tokens(name, "int", "SinhVien") + E.side_tokens(name[::-1], None, None) for name in names[:20]]
    records.append([(t, 0) for label in (*entry[0][2:5], *(entry[0][5] or "").split(";")) if label for t in E.name_tokens(label)] + [(f"w:{canon.telex(w, False)}", 0) for w in (entry[0][3] or "").split()])
    degree = np.bincount([t for r in records for t in {E._id(t) for t, _ in r}], minlength=E.TOKENS)
    assert np.allclose(weights, 1 / np.sqrt(1 + degree))


def test_calibration_takes_every_known_row(spark, tmp_path):
    """The weights are those fitted on all pairs of a group's 40 two-sided rows, its other answers weighing OTHERS rows together."""
    rng = random.Random(4)
    names = words(40)
    columns = [(k, "S", "A", "T", "sv", name, name[:4] + rng.choice("xz") if k % 3 else "zz" + name[2:], "int", rng.choice(["int", "text"]), k, 0) for k, name in enumerate(names)]
    model = trained(spark, tmp_path, columns)
    side = lambda c, m: {"name": c[6 if m == "s" else 5], "kind": c[8 if m == "s" else 7], "own_table": "T", "n1": c[9], "n2": c[10]}
    x, y = [], []
    for s in columns:
        for a in columns:
            left, right = side(s, "s"), side(a, "a")
            cosine = float(model.space.vector(model.tokens(left)) @ model.space.vector(model.tokens(right)))
            times = 20 if s is a else 3  # 1 and 6 of 40
            x += times * [E.features("column", model.names, left, right, cosine)]
            y += times * [float(s is a)]
    expected = E.fit_logistic(np.array(x), np.array(y), l2=20 * 1e-2)
    assert np.allclose(model.weights["column_mapping_report"], expected, atol=1e-3)


def test_rows_of_a_large_group_all_count(spark, tmp_path, monkeypatch):
    """Every row of a group that is cut into blocks is a known pair once, and so is a copy; rows without a submission count too."""
    names = words(150)
    columns = [(k, "S", "A", "T", "sv", name, name[::-1], "int", "int", 1, 0) for k, name in enumerate(names)]
    columns += [(1000, *columns[0][1:]), (1001, None, *columns[1][2:])]
    write(spark, tmp_path, columns, [])
    both = E.records(spark, str(tmp_path)).where("side LIKE 'both-%'")
    graph = [E.side_tokens(n, None, None) for n in names]
    for block in (20, 64, 1000):
        monkeypatch.setattr(E, "KNOWN_BLOCK", block)
        pairs = E.known_pairs(both, E.known_tables(spark, str(tmp_path)), E.Model(E.Space(graph), E.Names(ENTRIES))).toPandas()
        assert pairs.loc[pairs["y"] == 1, "n"].sum() == len(columns)
        assert 4.5 * len(names) <= pairs.loc[pairs["y"] == 0, "n"].sum() <= E.OTHERS * len(columns)


def test_blocks_of_the_graph(spark, tmp_path, monkeypatch):
    """Vectors trained in many blocks bring names together as those of one block do, and are the same each time."""
    rng = random.Random(5)
    columns = [(k, f"S{k}", "A", "SinhVien", "sv", n, rng.choice([vi, en, n.lower(), vi.upper()]) + rng.choice(["", "1", "x"]), "int", "int", 1, 0) for k, (n, vi, en) in enumerate(NAMES * 40)]
    write(spark, tmp_path, columns, [])
    rows = E.records(spark, str(tmp_path))
    for size in (10**6, 20):
        monkeypatch.setattr(E, "BLOCK_RECORDS", size)
        space = E.trained_space(rows, ENTRIES)
        v = lambda n: space.vector(E.side_tokens(n, None, None))
        for n, vi, en in NAMES:
            others = [v(m) for m, *_ in NAMES if m != n]
            assert v(en) @ v(n) > np.mean([v(en) @ o for o in others])
    again = E.trained_space(rows, ENTRIES)
    assert np.array_equal(space.vectors, again.vectors) and np.array_equal(space.weights, again.weights)


def test_more_of_the_same_gives_the_same_weights(spark):
    rng = np.random.default_rng(2)
    n = 400
    base = {"report": ["column_mapping_report"] * n, "cosine": rng.random(n), "cost": 4 * rng.random(n), **{c: rng.integers(-1, 2, n).astype(float) for c in ("other", "near", "second", "kinds", "tables")}}
    base["y"] = (rng.random(n) < 1 / (1 + np.exp(base["cost"] - 3 * base["cosine"]))).astype(float)
    pairs = lambda k: spark.createDataFrame(pd.DataFrame(base | {"n": np.full(n, float(k))})).repartition(3)
    once, often = (E.newton_by(pairs(k), 1e-2 * k)["column_mapping_report"] for k in (1, 50))
    cost = base["cost"]
    x = np.column_stack([np.ones(n), base["cosine"], cost, np.minimum(cost, 1), cost >= E.FOREIGN, *[base[c] for c in ("other", "near", "second", "kinds", "tables")]])
    assert np.allclose(once, E.fit_logistic(x, base["y"]), atol=1e-6) and np.allclose(once, often, atol=1e-6)
    assert E.newton_by(pairs(1).where("y = 1")) == {}


def test_reliability():
    assert E.reliability([(0.05, 0), (0.95, 1), (1.0, 1), (0.96, 0)]) == [(0.05, 0.0, 1), (pytest.approx(0.97), pytest.approx(2 / 3), 3)]


def test_record_odds_are_those_of_features(spark):
    """What the plan adds for positions and counts equals the features the weights were fitted on."""
    rng = random.Random(6)
    names = E.Names([(e[0], *e[1:]) for e in ENTRIES])
    values = [None, 0, 1, 2, 5, 40, 1000]
    rows = [(r, *(rng.choice(values) for _ in range(4))) for r in E.REPORTS for _ in range(60)]
    weights = {r: np.arange(10) / 7 + k for k, r in enumerate(E.REPORTS)}
    got = spark.createDataFrame(rows, "report string, s_n1 int, a_n1 int, s_n2 int, a_n2 int").select(E.record_odds(weights)).collect()
    for (report, s1, a1, s2, a2), (odds,) in zip(rows, got):
        side = lambda n1, n2: {"name": "x", "n1": n1, "n2": n2, "kind": None, "own_table": None}
        x = E.features(E.Model.kind(report), names, side(s1, s2), side(a1, a2), 0.0)
        assert odds == pytest.approx(weights[report][6] * x[6] + weights[report][7] * x[7])


def test_logistic():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(500), rng.normal(size=500)])
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 1])))).astype(float)
    w = E.fit_logistic(x, y)
    assert abs(w[0] - 0.5) < 0.4 and abs(w[1] - 2) < 0.5
