import random

from docloom.llm.linededup import dedup_lines, summary

BLANKS = " \t\n\v\f\r"


def brute(rows, sites):
    spread, first = {}, {}
    for d, text, source, *_ in rows:
        for pos, raw in enumerate((text or "").split("\n")):
            if line := raw.strip(BLANKS):
                spread.setdefault(line, set()).add(source)
                at = (d is None, d or 0, pos)
                first[line] = min(first.get(line, at), at)
    out = []
    for d, text, *_ in rows:
        if text is None:
            out.append((d, None))
            continue
        kept = [raw for pos, raw in enumerate(text.split("\n")) if not ((line := raw.strip(BLANKS)) and len(spread[line]) >= sites and first[line] != (d is None, d or 0, pos))]
        out.append((d, "\n".join(kept)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    common = [f"line {i}" for i in range(8)]
    rows = [(i, "\n".join(rng.choice(common + ["", " ", f"own {i} {rng.random()}"]) + rng.choice(["", " ", "\t\r"]) for _ in range(rng.randint(0, 9))), f"s{rng.randrange(9) if i % 3 else 0}", 1) for i in range(300)]
    rows += [(300, None, "s1", 1), (301, "", "s1", 1), (302, "rare\nrare\nline 1", None, 1), (303, "line 2 " + "x" * 200_000 + "\nline 1", "s2", 1), (None, "line 1\nno id", "s3", 1)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, drop int")
    for sites in (2, 5, 9):
        got = dedup_lines(df, sites)
        assert got.columns == ["doc_id", "text", "source", "drop", "lines"]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute(rows, sites), key=str)
    assert summary(df.limit(0)).count() == 0
    r = summary(df).where("doc_id = 303").first()
    assert r.n_lines == 2 and r.n_removed in (0, 1)
