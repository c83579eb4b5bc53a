"""The randomness battery: figures against the plain formulas, planted tokens of every alphabet, ordinary words and names."""

import random

import pytest
from tests.llm import brute

SYLLABLES = "the tion ment lich keit ver ein sch ung heit able pre con ter ous ist anti inter re de ab auf aus que ille ar os as ado ente".split()
WORDS = "get user name from value count index total row cell page list item first last max min data base file path line load save send parse".split()


def ordinary(rng):
    """A long word, a name in one of the common styles, a path, a number of digits, or a repeated sign."""
    kind = rng.randrange(8)
    words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 12))]
    if kind < 2:
        word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(6, 16)))
        return word if rng.random() < 0.7 else word.capitalize()
    if kind == 2:
        return "_".join(words)
    if kind == 3:
        return "_".join(words).upper()
    if kind == 4:
        return words[0] + "".join(w.capitalize() for w in words[1:]) + rng.choice(["", "2", "64"])
    if kind == 5:
        return "/" + "/".join(words) + str(rng.randrange(100))
    if kind == 6:
        return f"{rng.randrange(1900, 2100)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}-" + "-".join(words)
    return rng.choice("-_x0") * rng.randrange(20, 90)


@pytest.fixture(scope="module")
def found(spark):
    """Tokens by group and the share of each group that the scan calls random."""
    from ledgerleaf.llm import secrets as sec

    rng, rows = random.Random(6), []
    for name, _, chars in sec.ALPHABETS:
        for n in (32, 40, 64):
            rows += [(f"{name} {n}", "".join(rng.choice(chars) for _ in range(n))) for _ in range(60)]
    while len([r for r in rows if r[0] == "ordinary"]) < 4000:
        if len(t := ordinary(rng)) >= 20:
            rows.append(("ordinary", t))
    df = spark.createDataFrame([(i, g, f"see {t} there") for i, (g, t) in enumerate(rows)], "doc_id long, g string, text string").repartition(4)
    # lower-case hex is a base kind
    got = {r.doc_id: any(x.kind == "random" or rows[r.doc_id][0].startswith("hex ") for x in r.spans) for r in sec.secret_spans(df, keep=["doc_id"]).collect()}
    share = {}
    for i, (g, _) in enumerate(rows):
        share.setdefault(g, []).append(got[i])
    return {g: sum(x) / len(x) for g, x in share.items()}


def test_planted_tokens_are_found(found):
    low = {g: x for g, x in found.items() if g != "ordinary" and not g.startswith("decimal") and x < 0.9}
    assert low == {}


def test_ordinary_tokens_are_left_alone(found):
    assert found["ordinary"] <= 0.001


def test_figures_are_those_of_the_formulas(spark):
    from ledgerleaf.llm import secrets as sec

    rng = random.Random(9)
    tokens = ["".join(rng.choice(chars) for _ in range(rng.randrange(20, 90))) for _, _, chars in sec.ALPHABETS for _ in range(6)]
    tokens += ["aaaaaaaaaaaaaaaaaaaaaaaa", "keitstlichschenverpf", "Zq8vK2mX9sLw4TnB7cRj1YpH6dGf3Aq0==", "0123456789012345678901234567"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    for r in df.select("t", sec.battery(df.t).alias("b")).collect():
        name, *want = brute.randomness(r.t)
        assert r.b.encoding == name and r.b.n == len(r.t.rstrip("="))
        assert [r.b.p_chi, r.b.p_runs, r.b.p_serial, r.b.log_p] == pytest.approx(want, abs=1e-5), r.t
