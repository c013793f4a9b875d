"""Comparing names, and linking their variants."""

import pytest

from civictally.llm.components import connected_components
from civictally.llm.names import compare, jaro_winkler, normal_form, phonetic
from civictally.llm.variants import ACCEPT, name_variants, variant_pairs

SAME = [
    ("Lokmehadik,\tJennifer", "jennifer lokmehadik"), ("Dr. Tomas E. Kamdefovand", "tOMAS e. kAMDEFOVAND"), ("Andy Lokkahaten", "Andrew Lokkahaten"),
    ("Traiq Lokmedil", "Tariq Lokmedil"), ("T. Lokmedil", "Tariq Lokmedil"), ("Seddodeko, P K.", "Pamela K. Seddodeko"), ("Lumtakiten, Michael R.", "Michael R. Lumthakiten"),
    ("Maria Rydgunudov", "María Ridgunudov"), ("Mina Mattotod", "Mina C. Mattotod"), ("Lumtorisko Cab Drivers PAC", "Lumtorisko Cab Drivers Political Action Cmte"),
    ("Dimmolovo Millwrights LLC", "Dimmolovo Millwrights Limited Liability Company"), ("411 - Besgaluser Printers Union Local", "Besgaluser Printers Union Lcl 411"),
    ("Innkeepers Issues Committee of Melkapuler", "\"Melkapuler Innkeepers Issues Committee\"."), ("Matkerulik Millwrights Assoc. Incorporated", "Matkerulik Millwrights Associates Inc"),
]
DIFFERENT = [
    ("Ridgasud Holdings Local 851", "Ridgasud Holdings Local 854"), ("Robert Loknahavell", "Zachary Loknahavell"), ("Mina C. Mattotod", "Mina D. Mattotod"),
    ("Tariq Lokmedil", "Tariq Kamdefovand"), ("Derganolov Nurses Partnership", "Dondudoma Nurses Partnership"), ("J. Penmidilik", "Elizabeth Penmidilik"), ("Ann Lee", "Ann Lee PAC"),
    ("Steve Lokmedil", "Marta Lokmedil"), ("Joe Lokmedil", "Tony Lokmedil"), ("Tim Lokmedil", "Tom Lokmedil"), ("Maria Garcia", "Maria Garza"), ("Ed Hernandez", "Ed Fernandez"),
    ("Mary Ann Lokmedil", "Mary B. Lokmedil"), ("Rosa Bakers Lokmedil", "Rosa Lokmedil"), ("J. R. B. Lokmedil", "John R. C. Lokmedil"), ("Ann " + "x" * 30_000, "Ann " + "y" * 30_000),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    a, b = normal_form(a), normal_form(b)
    assert a == b or (compare(a, b) >= ACCEPT and compare(b, a) >= ACCEPT)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert compare(normal_form(a), normal_form(b)) < ACCEPT


def test_parts():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    assert phonetic("lumthakiten") == phonetic("lumtakiten") and phonetic("kukvonido") == phonetic("kukwonido")
    assert compare("maria lee", "marta lee") == 0 < ACCEPT <= compare("maria lee", "marta lee", frozenset())
    for text in (None, "", " . ", "UNITEMIZED", "City Matching Funds", "Interest Income"):
        assert normal_form(text) == ""


@pytest.mark.parametrize("swap", [False, True])
def test_linking(spark, swap):
    rows, want = [], set()
    for n, (a, b) in enumerate(SAME):
        if swap:
            a, b = b, a
        rows += [(2 * n, f" g{n}", a, 1), (2 * n + 1, f"g{n} ", b, 1), (5000 + n, f"g{n}", a, 1)]
        want.add((2 * n, 2 * n + 1))
    for n, (a, b) in enumerate(DIFFERENT):
        rows += [(200 + 2 * n, f"d{n}", a, 1), (201 + 2 * n, f"d{n}", b, 1)]
    # two relatives are not joined by an initial
    rows += [(900, "r", "Noor Murvukiskin", 1), (901, "r", "Nadia Murvukiskin", 1), (902, "r", "N. Murvukiskin", 1)]
    rows += [(950, None, "A B", 1), (951, " ", "A B", 1), (952, "r", None, 1), (None, "r", "Ann Bee", 1), (953, "r", "x" * 30_000, 1), (954, "s", "Unitemized", 1), (955, "s", "unitemized", 1)]
    df = spark.createDataFrame(rows, "row_id bigint, grp string, contributor string, id int")
    donors = name_variants([("t", df, "grp", "row_id", "contributor")])
    got = {(r.id_a, r.id_b) for r in variant_pairs(donors).collect()}
    assert {p for p in got if p[1] < 900} == want
    assert len({p for p in got if p[0] in (900, 901) and p[1] == 902}) == 1 and (900, 901) not in got
    assert name_variants([("t", df.where("false"), "grp", "row_id", "contributor")]).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 1)] + [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(2000, 2050)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert {n: got[n] for n in (1, 2, 3, 4, 5)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(2000, 2050)} == {1000} and 9 not in got
    assert connected_components(df.where("false")).count() == 0


GIVEN = "maria marta".split()
LAST = "belkov dunfa gormek hostil jurpan kelmot lindra morvet".split()


def linked(spark, rows):
    df = spark.createDataFrame(rows, "row_id bigint, grp string, contributor string")
    found = variant_pairs(name_variants([("t", df, "grp", "row_id", "contributor")])).collect()
    text = {r[0]: r[2] for r in rows}
    return {tuple(sorted((text[r.id_a], text[r.id_b]))) for r in found}


def test_one_donors_slip_in_most_groups(spark):
    rows = [(2 * n + i, f"g{n}", t) for n in range(60) for i, t in enumerate(("Oscar Ridgosudand", "Oscar Ridgousudand"))]
    rows += [(1000 + n, f"g{n}", f"{g} {s}") for n, (g, s) in enumerate((g, s) for g in GIVEN for s in LAST)]
    assert linked(spark, rows) == {("Oscar Ridgosudand", "Oscar Ridgousudand")}


@pytest.mark.parametrize("spread", [1, 40])
def test_names_of_their_own_at_every_size(spark, spread):
    rows = [(n, f"h{n}", f"{g} {s}") for n, (g, s) in enumerate([("Maria", s) for s in LAST[:5]] + [("Marta", s) for s in LAST[4:]])]
    rows += [(100 + i + 2 * n, f"g{n}", t) for n in range(spread) for i, t in enumerate(("Maria Belkov", "Marta Belkov"))]
    assert not linked(spark, rows)


@pytest.mark.parametrize("others", [0, 300])
def test_the_answer_is_the_pairs_own(spark, others):
    """Whatever else the table holds, and however often the words of the pair stand in it."""
    rows = [(i, "g", t) for i, t in enumerate(("Oscar Tilkunodar", "Oscar Tilkunedar", "Maria Tilkunodar", "Marta Tilkunodar", "Jose Luis Garcia", "Jose Garcia"))]
    rows += [(100 + 2 * n + i, f"h{n}", f"{g} {s}{'aeiou'[n % 5]}{'bdfgk'[n // 5 % 5]}o") for n in range(others) for i, g in enumerate(("Maria", "Marta")) for s in (LAST[n % 8], "Tilkunodar", "Tilkunedar")][: 2 * others]
    found = {p for p in linked(spark, rows) if p[0].startswith(("Oscar", "Jose")) or "Tilkunodar" in p}
    assert found == {("Oscar Tilkunedar", "Oscar Tilkunodar"), ("Jose Garcia", "Jose Luis Garcia")}


def test_middle_name_joins_no_two_people(spark):
    rows = [(1, "g", "Mary Lopez"), (2, "g", "Ann Lopez"), (3, "g", "Mary Ann Lopez"), (4, "g", "MARY LOPEZ")]
    found = linked(spark, rows)
    assert ("Ann Lopez", "Mary Lopez") not in found and ("Mary Ann Lopez", "Mary Lopez") in found and ("Ann Lopez", "Mary Ann Lopez") not in found


def test_slip_of_two_names(spark):
    rows = [(2 * n + i, f"g{n}", f"{t} {s}") for n, s in enumerate(LAST[:6]) for i, t in enumerate((GIVEN[n % 2], "Mara"))]
    assert len(linked(spark, rows)) == 6


MEET = [
    ("C W Recyclers 406", "C W Recyclrs 406"), ("Microsoft", "Mircosoft"), ("Olga Lokmedil", "Ogla Lokmedil"), ("Uma Lokmedil", "Uha Lokmedil"),
    ("T. Lokmedil", "T. Lokmehil"), ("T. Lokmehil", "Tariq Lokmedil"), ("Acme", "Amce"),
    ("Alexander Lokmedil", "Aleksnader Lokmedil"), ("Elizabeth Lokmedil", "Elizbaeht Lokmedil"), ("Christopher Lokmedil", "Chrsitofer Lokmedil"), ("Omar Lumtorisko", "Omar Lumtroikso"),
    ("Jose Luis Garcia", "Jose Garcia"), ("Mary Ann Lopez", "Mary Lopez"), ("Mary Ann Lopez", "Mary A. Lopez"), ("Peggy Ann Lopez", "Margaret Lopez"), ("J. R. R. Lokmedil", "John R. R. Lokmedil"),
    ("J. R. R. Lokmedil", "John Lokmedil"), ("Steven Lokmedil", "Stephen Lokmedil"), ("Dimmolovo Nurses Assoc. Inc.", "Dimmolovo Nurses Associates Inc."),
]


def test_every_accepted_pair_meets(spark):
    assert linked(spark, [(2 * n + i, f"g{n}", t) for n, p in enumerate(MEET) for i, t in enumerate(p)]) == {tuple(sorted(p)) for p in MEET}
