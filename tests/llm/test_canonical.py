"""Mapping typed values to a list."""

import pytest

from civictally.llm.canonical import map_to_canonical

REF = [
    (1, "employer", "Tadgenasken Department of Water", None), (2, "employer", "Dimdetutov Unified School District", "DIMUSD"),
    (3, "employer", "Kuktikina Medical Center", None), (4, "employer", "Turkeker Motion Pictures", None), (5, "employer", "Donlusoland Department of Water", None),
    (6, "employer", "Self-Employed", None), (7, "employer", "Not Employed", None), (8, "occupation", "Registered Nurse", "RN"),
    (9, "occupation", "Chief Executive Officer", "CEO"), (10, "occupation", "Accountant", None), (11, "occupation", "Architect", None),
    (12, "occupation", "Certified Public Accountant", "CPA"), (13, "occupation", "Real Estate Broker", None), (14, "occupation", "General Contractor", None),
    (18, "occupation", "Photographer", None), (19, "occupation", "Veterinarian", None), (15, "occupation", "Software Engineer", None), (16, "occupation", "Civil Engineer", None), (None, "occupation", "Nobody", None), (17, "occupation", None, "X"),
]

EMPLOYERS = {
    "TADGENASKEN DEPT. OF WATER": 1, "Department of Water, Tadgenasken": 1, "Tadgenaksen department of water": 1, "The Donlusoland Department of  Water (HQ)": 5,
    "dimusd": 2, "Dimdetutov UnifiedSchool District": 2, "Dimdetutov Unified Sch Dist": 2, "KuktikinaM edical Center": 3, "Kuktikina Med Ctr": 3,
    "TURKEKER PICTURES": 4, "Unemployed": 7, "self-emp.": 6, "SELF": 6, "Selfemployed": 6, "Department of Water": 0, "Rolvupaland Upholstery": 0, "...": 0,
    "Zzyzx Medical Center": 0, "x" * 20_000: 0,
}
JOBS = {
    "R.N.": 8, "rn": 8, "Regi. Nurse": 8, "ceo": 9, "Chief Exec. Officer": 9, "Acct.": 10, "C.P.A.": 12, "R.E. Broker": 13, "GEN'L CONTRACTOR": 14,
    "Engineer, Software": 15, "SOFTWARE ENGR": 15, "CivilE ngineer": 16, "Sundial Wrangler": 0,
    "fotographer": 18, "photagrapfer": 18, "Acountent": 10, "vetrinarien": 19, "Sofware Enginer": 15, "cvl engineer": 16, "Arkitekt": 0, "engineer": 0, "aktor": 0,
}


@pytest.mark.parametrize("max_rows", [0, 100_000])
def test_mapping(spark, max_rows):
    ref = spark.createDataFrame(REF, "ref_id int, kind string, canonical_name string, short_name string")
    typed = [(i, v, n) for i, (v, n) in enumerate(EMPLOYERS.items())]
    silent = [None, "", " \t", "N/A", " none ", "Self-Employed"]
    df = spark.createDataFrame(typed + [(100 + i, v, 0) for i, v in enumerate(silent)], "row_id int, contrib_employer string, ref_id int")
    jobs = spark.createDataFrame(list(enumerate(JOBS)), "row_id int, job string")
    df, jobs = df.union(df.where("row_id = 0")), jobs.union(jobs.selectExpr("null", "job").where("job = 'rn'"))
    got = map_to_canonical([("e", df, "row_id", "contrib_employer", "employer"), ("j", jobs, "row_id", "job", "occupation")], ref, max_rows).collect()
    values = list(JOBS)
    assert {(v, n) for _, v, n in typed} == {(typed[r.row_key][1], r.ref_id) for r in got if r.source_field == "e"}
    assert {v: n for v, n in JOBS.items()} == {values[r.row_key]: r.ref_id for r in got if r.source_field == "j" and r.row_key is not None}
    assert len(got) == len(typed) + 1 + len(JOBS) + 1


def test_empty(spark):
    ref = spark.createDataFrame([], "ref_id int, kind string, canonical_name string, short_name string")
    df = spark.createDataFrame([(1, "a")], "row_id int, v string")
    assert [r.ref_id for r in map_to_canonical([("e", df, "row_id", "v", "employer")], ref).collect()] == [0]
    assert map_to_canonical([("e", df.where("false"), "row_id", "v", "employer")], ref).count() == 0
