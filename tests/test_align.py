import random

import pytest

from traitforge import cli
from traitforge.operators import align
from traitforge.operators.align import Scoring, align_pairs
from traitforge.plans import workflows as W

S = Scoring()
TABLE = S.table()


def full(q, t, whole):
    """Score by the whole dynamic program."""
    none = -(10**9)
    h, e, f = ([[none] * (len(t) + 1) for _ in range(len(q) + 1)] for _ in range(3))
    h[0][0], best = 0, 0
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            if i == 0 and j == 0 or not whole and (i == 0 or j == 0):
                h[i][j] = 0
                continue
            if i:
                f[i][j] = max(h[i - 1][j] - S.first_gap, f[i - 1][j] - S.gap)
            if j:
                e[i][j] = max(h[i][j - 1] - S.first_gap, e[i][j - 1] - S.gap)
            h[i][j] = max(h[i - 1][j - 1] + int(TABLE[q[i - 1], t[j - 1]]) if i and j else none, e[i][j], f[i][j], none if whole else 0)
            best = max(best, h[i][j])
    return h[len(q)][len(t)] if whole else best


def rescored(q, t, i, j, path):
    score, before = 0, 0
    for c in path:
        if c == 77:
            score += int(TABLE[q[i], t[j]])
        else:
            score -= S.gap if c == before else S.first_gap
        i, j, before = i + (c != 84), j + (c != 81), c
    return score, i, j


def word(r, n):
    return "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))


def changed(r, text, times):
    for _ in range(times):
        k, lot = r.randint(0, len(text)), r.random()
        text = text[:k] + (text[k + r.randint(1, 3) :] if lot < 0.35 else word(r, r.randint(1, 3)) + text[k:] if lot < 0.7 else word(r, 1) + text[k + 1 :])
    return text


@pytest.mark.parametrize("whole", [False, True])
def test_alignments_equal_the_whole_program(whole):
    r = random.Random(1)
    pairs = []
    for _ in range(250):
        a = word(r, r.randint(1, 40))
        pairs.append((a.encode(), (changed(r, a, r.randint(0, 7)) or "A").encode(), 0, 60))
    for (q, t, _, _), (score, i, j, path) in zip(pairs, align_pairs(pairs, S, whole), strict=True):
        again = rescored(q, t, i, j, path)
        assert score == full(q, t, whole) == again[0]
        assert not whole or ((i, j), again[1:]) == ((0, 0), (len(q), len(t)))
    assert align_pairs([(b"", b"AC", 0, 5), (b"AC", b"", 0, 5)], S, True) == [(0, 0, 0, b"TT"), (0, 0, 0, b"QQ")]


def test_chance_scale_balances():
    n = sum(map(len, align.ALIKE))
    letters = "".join(align.ALIKE).encode()
    mean = sum(2.718281828459045 ** (S.scale() * float(TABLE[a, b])) for a in letters for b in letters) / n**2
    assert mean == pytest.approx(1, abs=1e-9)


def test_hits_have_places_identity_and_scores(spark):
    r = random.Random(2)
    base = [word(r, 60) for _ in range(4)]
    rows = [(f"b{k}", s) for k, s in enumerate(base)] + [(f"m{k}", word(r, 9) + changed(r, s, 3) + word(r, 5)) for k, s in enumerate(base)] + [("none", None), ("short", "AC"), ("far", word(r, 50))]
    proteins = spark.createDataFrame(rows, "protein_id string, sequence string")
    found = {(h.query, h.target): h for h in align.alignment_hits(proteins, proteins, k=4, most_expected=1e9).collect()}
    text = dict(rows)
    for k in range(4):
        assert (f"b{k}", f"m{k}") in found and (f"m{k}", f"b{k}") in found
    for (a, b), h in found.items():
        assert h.raw == full(text[a].encode(), text[b].encode(), False)
        assert (h.query_length, h.target_length) == (len(text[a]), len(text[b]))
        if a == b:
            assert (h.identity, h.query_start, h.query_end, h.gaps) == (1.0, 1, len(text[a]), 0) and h.e_value < 1e-3
        assert 1 <= h.query_start <= h.query_end <= h.query_length and h.columns >= h.gaps
    assert not {"none", "short"} & {a for a, _ in found}
    strict = align.alignment_hits(proteins, proteins, k=4, least_identity=0.99, coverage=0.99)
    assert {(h.query, h.target) for h in strict.collect()} == {(p, p) for p, s in rows if s and len(s) >= 4}


def test_cover_equals_going_through_them_one_by_one(spark):
    r = random.Random(5)
    names = [f"p{i:02d}" for i in range(40)]
    length = {n: r.randint(3, 9) for n in names}
    links = {(a, b) for a in names for b in names if a < b and r.random() < 0.07}
    near = {n: {b for a, b in links if a == n} | {a for a, b in links if b == n} for n in names}
    heads, want = [], {}
    for n in sorted(names, key=lambda n: (-len(near[n]), -length[n], n)):
        head = next((h for h in heads if h in near[n]), None)
        if head is None:
            heads.append(n)
        want[n] = head or n
    proteins = spark.createDataFrame([(n, "A" * length[n]) for n in names] + [(names[0], "A" * length[names[0]])], "protein_id string, sequence string")
    rows = spark.createDataFrame([*links, *[(n, n) for n in names]], "query string, target string")
    assert sorted((x.protein_id, x.cluster) for x in align.cover_families(proteins, rows).collect()) == sorted(want.items())
    assert align.cover_families(proteins.limit(0), rows.limit(0)).count() == 0


def test_chains_are_not_one_family(spark):
    r = random.Random(8)
    a, b = word(r, 40), word(r, 40)
    rows = [("left", a), ("middle", a[10:] + b[:30]), ("right", b)]
    proteins = spark.createDataFrame(rows, "protein_id string, sequence string")
    got = {x.protein_id: x.cluster for x in align.protein_families(proteins, k=4, least_identity=0.5, coverage=0.4).collect()}
    assert got == {"left": "middle", "middle": "middle", "right": "middle"}
    got = {x.protein_id: x.cluster for x in align.protein_families(proteins, k=4, least_identity=0.5, coverage=0.8).collect()}
    assert len(set(got.values())) == 3


def test_family_alignments(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for f in range(3):
        base = word(r, 50)
        rows += [(f"f{f}m0", f"f{f}m0", base)] + [(f"f{f}m0", f"f{f}m{k}", changed(r, base, 4)) for k in range(1, 6)]
    rows += [("f0m0", "empty", None), ("headless", "x", "ACD")]
    members = spark.createDataFrame(rows, "family string, protein_id string, sequence string")
    got = {x.protein_id: x for x in align.align_families(members).collect()}
    assert set(got) == {p for f, p, _ in rows if f != "headless"}
    for f in ("f0m0", "f1m0", "f2m0"):
        assert len({len(x.aligned) for x in got.values() if x.family == f}) == 1
    for f, p, s in rows:
        if f != "headless":
            assert got[p].aligned.replace("-", "") == (s or "")
    # Equal columns: most of a changed member's residues stand under the representative's.
    same = sum(a == b != "-" for a, b in zip(got["f1m0"].aligned, got["f1m3"].aligned, strict=True))
    assert same > 30
    proteins = members.filter("family <> 'headless'").select("protein_id", "sequence")
    families = members.select(families_col := "family", "protein_id").withColumnRenamed(families_col, "cluster")
    kmer = rows[0][2][10:14]
    maps = spark.createDataFrame([(f"f0m0_{kmer}", "sc_0")], "cluster string, feature string")
    done = W.kmer_coverage_workflow(spark, str(tmp_path), spark.createDataFrame([("sc_0",)], "feature string"), maps, families, proteins, None, k=4, make_alignments=True)
    assert done["status"] == "done"
    assert done["segments"].filter("coverage = 1 AND protein_id = 'f0m0'").count() >= 1
    args = cli.parser().parse_args(["kmer-coverage", "--input", "a", "--families", "b", "--proteins", "c", "--output", "d", "--gap_aware"])
    assert args.gap_aware and args.alignments is None
