import datetime
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import splitting as P

SCHEMA = "id bigint, indexed_at timestamp, unit string, line_start int, code string, total string, cut string"


def frame(spark, codes):
    day = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, day, "u", 10, c, "clash", "clash") for i, c in enumerate(codes)], SCHEMA)


def texts():
    rnd = random.Random(7)
    out = []
    for _ in range(14):
        t = ""
        while len(t) < rnd.choice([500, 1500, 4000]):
            t += "x" * rnd.choice([0, 1, 5, 30, 80, 95, 99, 100, 101, 250]) + rnd.choice(["\n", "\r\n", "\r", "\n\n", "}\n"])
        out.append(t)
    return [*out, "y" * 1000, "\r\n" * 300, "z" * 95 + "\r\n" + "w" * 300, "ğ😀" * 200 + "\nab" * 100]


def test_pieces_lose_nothing_whatever_the_ranges(spark):
    codes, limit, overlap = texts(), 100, 20
    for size in (7, 64, 65_536):
        got = {}
        for r in P.pieces(frame(spark, codes), limit, overlap, size).orderBy("id", "piece_no").collect():
            got.setdefault(r.id, []).append(r)
        assert set(got) == {i for i, c in enumerate(codes) if len(c) > limit}
        for i, ps in got.items():
            c = codes[i]
            ends = {m.end() for m in re.finditer(r"\r\n|\r|\n", c)} | {len(c)}
            assert "".join(p.piece[p.core_start - p.char_start :] for p in ps) == c
            assert [p.piece_no for p in ps] == list(range(1, len(ps) + 1))
            at = [0, *sorted(ends)]
            long = [(a, b) for a, b in zip(at, at[1:]) if b - a > limit]
            for a, p in zip([None, *ps], ps):
                assert len(p.piece) <= limit
                assert p.n_pieces == len(ps)
                if a:
                    assert p.core_start == a.char_end
                    whole = p.char_end - p.core_start <= limit - overlap
                    assert p.core_start - p.char_start == (min(overlap, p.core_start) if whole else limit - (p.char_end - p.core_start))
                # a cut beside a line end only inside a line that is too long
                assert p.char_end in ends or any(x < p.char_end < y for x, y in long)
                line = lambda pos: 10 + sum(e <= pos for e in sorted(ends)[: len(ends)] if e < len(c) or c[-1:] in "\r\n")
                assert p.line_start == line(p.char_start)
                assert p.line_end == line(p.char_end - 1)


def test_found_tells_hard_from_soft(spark):
    codes = texts()
    want = {(i, "hard" if max(map(len, re.split(r"\r\n|\r|\n", c))) > 100 else "soft") for i, c in enumerate(codes) if len(c) > 100}
    assert {tuple(r) for r in P.found(frame(spark, codes), 100).collect()} == want


def test_nulls_versions_ties_empty(spark):
    d = lambda n: datetime.datetime(2024, 1, n)
    big = "a\n" * 3000
    rows = [(1, d(1), "u", None, big, "", ""), (1, d(2), "u", None, "short", "", ""), (2, d(2), None, None, big, "", ""), (2, d(2), None, None, big, "", ""), (3, None, "u", 1, None, "", ""), (None, d(1), "u", 1, big, "", ""), (4, None, "u", 1, "x" * 4001, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, P.found(df).collect())) == [(2, "soft"), (4, "hard")]
    assert {r.id for r in P.pieces(df).collect()} == {2, 4}
    assert P.pieces(df.limit(0)).count() == P.found(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 80), max_size=40), st.integers(10, 60), st.integers(0, 30))
def test_cuts_are_line_ends_or_inside_long_lines(lengths, limit, rest):
    bounds = [5 + sum(lengths[: i + 1]) for i in range(len(lengths))]
    step, end = limit - limit // 5, (bounds[-1] if bounds else 5) + rest
    cuts = P._cuts(5, end, bounds, bounds[::3], limit, step)
    assert cuts == sorted(set(cuts)) and cuts[-1:] == ([end] if end > 5 else [])
    ends = [5, *cuts]
    assert all(b - a <= limit for a, b in zip(ends, ends[1:]))
    lines = [5, *bounds, *([end] if rest else [])]
    for c in cuts:
        assert c in lines or any(a < c < b and b - a > limit for a, b in zip(lines, lines[1:]))


def test_pieces_are_nearly_full(spark):
    code = "".join(f"    line {i} of some length = {i * i};\n" + ("}\n\n" if i % 7 == 0 else "") for i in range(9000))  # five ranges
    ps = P.pieces(frame(spark, [code])).orderBy("piece_no").collect()
    sizes = [p.char_end - p.char_start for p in ps]
    assert sorted(sizes)[len(sizes) // 2] > 3700 and sizes[0] > 3500 and min(sizes[:-1]) > 3000
    assert "".join(p.piece[p.core_start - p.char_start :] for p in ps) == code


def test_ranges_of_long_texts_are_spread_and_equal(spark, monkeypatch):
    codes = texts()
    want = sorted(map(tuple, P.pieces(frame(spark, codes), 100, 20, 64).collect()))
    monkeypatch.setattr(P.range_texts, "__defaults__", (200,))
    monkeypatch.setattr(P.boundary_tables, "__defaults__", (P.RANGE, 200))
    assert sorted(map(tuple, P.pieces(frame(spark, codes), 100, 20, 64).collect())) == want
