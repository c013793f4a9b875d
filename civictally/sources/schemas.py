"""Schemas of the inputs and outputs; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L = T.StringType(), T.LongType()


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, S) for n in names])


# The columns of the exported files and of the paged service.
CONTRIBUTION_HEADERS = (
    "Contribution Date", "Contributor", "Contrib Occupation", "Contrib Employer", "Committee Name", "Committee ID",
    "Period Beg Date", "Period End Date", "Contribution Amount", "Contribution Type", "Election Date",
)
SERVICE_FIELDS = {
    "contribution_date": "con_date", "contributor": "con_name", "committee_name": "cmt_nm", "committee_id": "cmt_id",
    "period_beg_date": "per_beg_date", "period_end_date": "per_end_date", "contribution_amount": "con_amount",
    "contribution_type": "con_type", "election_date": "election_date",
}
STATEMENT_COLUMNS = ("cmt_id", "period_from_date", "period_to_date", "stmt_link")

LINK = T.StructType([T.StructField("name", S), T.StructField("url", S)])
OFFICIALS = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("name", S),
        T.StructField("office", S),
        T.StructField("party", T.StructType([T.StructField("affiliation", S), T.StructField("source", LINK)])),
    ]
)
REGISTRY = T.StructType(
    [
        T.StructField("schema_version", S),
        T.StructField(
            "officials",
            T.MapType(
                S,
                T.StructType(
                    [
                        T.StructField("funding", T.StructType([T.StructField("committees", T.ArrayType(S)), T.StructField("election_result", S)])),
                        T.StructField("record", T.StructType([T.StructField("source", LINK), T.StructField("fixture", S)])),
                    ]
                ),
            ),
        ),
    ]
)
RECORD_ITEM = strings("council_file", "title", "role", "date", "outcome", "term")
RECORD_FILE = T.StructType([T.StructField("official_id", S), T.StructField("items", T.ArrayType(RECORD_ITEM))])
REQUEST = T.StructType(
    [T.StructField("question", S), T.StructField("official", strings("id", "name", "title", "party"))]
)
