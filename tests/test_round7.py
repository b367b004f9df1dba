"""Switches of many pairs are searched for together, on bands of the tables where no better one can be outside."""

import random

import pyarrow as pa

from helixtab.functions.seq import ALPHABETS
from helixtab.operators import tables
from helixtab.sources.costs import load_costs, of_set

COMPLEMENT = str.maketrans(*ALPHABETS["dna-n"])


def test_bands_find_what_whole_tables_do(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for i in range(120):
        r = "".join(rng.choices("ACGT", k=rng.randrange(50, 130)))
        q = "".join(c if rng.random() > 0.04 else rng.choice(["", "A", c + "G"]) for c in r)
        if i % 3:
            at, to, n = rng.randrange(len(q) - 20), rng.randrange(len(r) - 20), rng.randrange(5, 19)
            q = q[:at] + r[to : to + n][::-1].translate(COMPLEMENT) + q[at + n :]
        if i % 10 == 0:  # far off the diagonal, where the band isn't enough
            q = "".join(rng.choices("ACGT", k=40)) + q[:20]
        if i % 15 == 0:
            r, q = "AT" * 40, "TA" * 30
        rows.append((r, q, rng.randrange(3), rng.randrange(3)))
    rows += [("", "ACGT", 0, 0), ("ACGT" * 20, "", 0, 0), (None, "ACGT", 0, 0)]
    batch = pa.RecordBatch.from_pydict({"pair_id": list(range(len(rows))), "a": [r and r[x:] for r, _, x, _ in rows], "b": [q and q[y:] for _, q, _, y in rows], "a_start": [x for *_, x, _ in rows], "b_start": [y for *_, y in rows], "r_seq": [r for r, *_ in rows], "q_seq": [q for _, q, *_ in rows]})
    row, cells = tables.Sweep.row, [0]

    def counted(self, i, before):
        cells[0] += self.width * self.x.shape[1]
        return row(self, i, before)

    monkeypatch.setattr(tables.Sweep, "row", counted)
    for name in ("sample", "experiments"):
        c = tables.Costs.of(of_set(load_costs(spark), name))
        for longest in (True, False):
            cells[0] = 0
            found, filled = tables._called(batch, c, c.shortest(), longest), cells[0]
            with monkeypatch.context() as whole:
                whole.setattr(tables, "BAND", 1 << 20)
                assert found == tables._called(batch, c, c.shortest(), longest)
            assert sum(x[0] is not None for x in found) > 40
    # pairs of the last set without inverted repeats have no tables, and others narrow ones
    assert filled < 0.7 * sum(2 * (len(r) + 1) * (len(q) + 1) for r, q, *_ in rows if r and q)
    # in parts, as on long repeats
    monkeypatch.setattr(tables, "PLACES", 50)
    monkeypatch.setattr("helixtab.operators.anchors.HELD", 50)
    assert found == tables._called(batch, c, c.shortest(), longest)
