"""Golden change events: which fields each touches and the values they get."""

import json

from pyspark.sql import functions as F

from tidemark.operators.normalize import accepted, normalize_changes, normalize_notices, rejected, typed



def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


CONTACT = {
    "Name": "string", "FirstName": "string", "LastName": "string",
    "OtherAddress": "string", "OtherStreet": "string", "OtherCity": "string", "OtherState": "string",
    "OtherPostalCode": "string", "OtherCountry": "string", "OtherLatitude": "double",
    "MailingAddress": "string", "MailingStreet": "string", "MailingCity": "string",
    "MailingState": "string", "MailingPostalCode": "string", "MailingCountry": "string",
    "LastModifiedDate": "datetime", "Amount": "currency", "Fiscal": "string",
    "FiscalYear": "int", "FiscalQuarter": "int", "Description": "textarea",
}
KEY = "a1B"


def change(spark, payload, header=None, fields=CONTACT, **options):
    head = {"recordIds": [KEY], "changeType": "UPDATE", "commitTimestamp": 1700000000000, **(header or {})}
    body = json.dumps({**payload, "ChangeEventHeader": head}, ensure_ascii=False)
    df = spark.createDataFrame([(1, body)], "seq long, body string")
    return normalize_changes(df, fields, now(), **options).collect()


def test_compounds_of_every_parent(spark):
    """Rules P9-P16: parts named in the header or present in the value are targets of their own."""
    fields = {"Name": "string", "FirstName": "string", "LastName": "string"}
    for parent in ("Billing", "Shipping", "Mailing", "Other"):
        fields |= {f"{parent}{part}": "string" for part in ("Address", "Street", "City", "State", "PostalCode", "Country")}
    payload = {"Name": {"FirstName": " Ada ", "LastName": "Quill", "Salutation": "Dr."}}
    for i, parent in enumerate(("Billing", "Shipping", "Mailing", "Other")):
        payload[f"{parent}Address"] = {"City": f"Port {i}", "Street": f"{i} Quay\t", "Country": "Oz"}
    [r] = change(spark, payload, {"changedFields": ["Name", "BillingAddress", "OtherAddress.City"]}, fields)
    assert r.vals.Name == "Dr. Quill Ada"
    assert (r.vals.FirstName, r.vals.LastName) == (" Ada ", "Quill")
    for i, parent in enumerate(("Billing", "Shipping", "Mailing", "Other")):
        assert {f"{parent}{p}" for p in ("Address", "City", "Street", "Country")} <= set(r.target_fields)
        assert r.vals[f"{parent}Address"] == f"Oz Port {i} {i} Quay"
        assert r.vals[f"{parent}City"] == f"Port {i}" and r.vals[f"{parent}State"] is None
        assert f"{parent}State" not in r.target_fields
    assert r.reject_reason is None


def test_changed_part_that_is_absent_becomes_null(spark):
    fields = {"ShippingAddress": "string", "ShippingCity": "string", "ShippingState": "string"}
    [r] = change(spark, {"ShippingAddress": {"State": "North"}}, {"changedFields": ["ShippingCity", "ShippingAddress"]}, fields)
    assert set(r.target_fields) == {"ShippingAddress", "ShippingCity", "ShippingState"}
    assert (r.vals.ShippingAddress, r.vals.ShippingCity, r.vals.ShippingState) == ("North", None, "North")


def test_repeated_members_and_white_space(spark):
    """The last of several members of one name counts; tabs and line ends are white space."""
    body = (
        '{"ChangeEventHeader":{"recordIds":["k1"],"changeType":"UPDATE","changedFields":["\\tDescription","Amount","Fiscal"]},'
        '"Description":"first","Description":"second","Amount":"\\t5\\n","Fiscal":{"Year":2024,"Year":2025,"Quarter":3}}'
    )
    df = spark.createDataFrame([(1, body)], "seq long, body string")
    [r] = accepted(typed(normalize_changes(df, CONTACT, now()), CONTACT)).collect()
    assert (r.vals.Description, r.vals.Amount, r.vals.Fiscal, r.vals.FiscalYear) == ("second", 5.0, "2025 3", 2025)
    blank_key = spark.createDataFrame([(1, '{"ChangeEventHeader":{"recordIds":["\\t"],"changeType":"UPDATE"},"Amount":1}')], "seq long, body string")
    [r] = normalize_changes(blank_key, CONTACT, now()).collect()
    assert r.reject_reason == "no_key"


def test_first_name_only(spark):
    for changed in ("FirstName", "Name", "Name.FirstName"):
        [r] = change(spark, {"Name": {"FirstName": "A"}}, {"changedFields": [changed]})
        assert set(r.target_fields) == {"Name", "FirstName"}
        assert (r.vals.Name, r.vals.FirstName) == ("A", "A")


def test_last_name_only(spark):
    [r] = change(spark, {"Name": {"LastName": "B"}}, {"changedFields": ["Name"]})
    assert set(r.target_fields) == {"Name", "LastName"}
    assert r.vals.LastName == "B"


def test_bitmap_alone_and_empty_header_mean_all_payload_fields(spark):
    for header in ({"changedFields": ["0x06000100"]}, {}, {"changedFields": ["Unknown__c"]}):
        [r] = change(spark, {"Amount": 5, "Description": "d", "Other__c": 1, "Id": KEY}, header)
        assert set(r.target_fields) == {"Amount", "Description"}


def test_values_wrappers_and_nulls(spark):
    [r] = change(
        spark,
        {"Amount": {"newValue": 12.5}, "Description": {"stringValue": "x"}, "OtherCity": {"value": None}},
        {"changedFields": ["Amount", "Description", "OtherCity", "OtherState"], "nulledFields": ["Description"]},
    )
    assert r.vals.Amount == "12.5"
    assert r.vals.Description is None  # nulled
    assert r.vals.OtherCity is None and r.vals.OtherState is None  # changed, absent
    assert set(r.target_fields) == {"Amount", "Description", "OtherCity", "OtherState"}
    [r] = change(spark, {"Description": {"stringValue": "x"}}, {"changedFields": ["Description"]})
    assert r.vals.Description == "x"
    [r] = change(spark, {"Description": {"a": 1, "b": 2}}, {"changedFields": ["Description"]})
    assert json.loads(r.vals.Description) == {"a": 1, "b": 2}


def test_fiscal(spark):
    [r] = change(spark, {"Fiscal": {"Year": 2024, "Quarter": 3}}, {"nulledFields": ["Fiscal"]})
    assert (r.vals.Fiscal, r.vals.FiscalYear, r.vals.FiscalQuarter) == ("2024 3", "2024", "3")
    assert r.nulled_fields == []
    [r] = change(spark, {"Fiscal": {"Year": 2024}, "Amount": 1}, {"changedFields": ["Fiscal", "Amount"]})
    assert r.target_fields == ["Amount"]


def test_times_and_key(spark):
    [r] = change(spark, {"LastModifiedDate": "2023-11-14T22:13:20.000+0000", "Amount": 1})
    assert str(r.lm) == "2023-11-14 22:13:20" and str(r.ev) == "2023-11-14 22:13:20"
    [r] = change(spark, {"Amount": 1}, {"changeType": "DELETE", "commitTimestamp": None})
    assert r.lm is None and str(r.ev) == "2024-05-01 00:00:00"
    [r] = change(spark, {"Amount": 1, "Id": "own"}, {"recordIds": []})
    assert r.sfid == "own"
    rows = change(spark, {"Amount": 1}, {"recordIds": ["a", "b"]}, all_record_ids=True)
    assert [x.sfid for x in rows] == ["a", "b"]
    [r] = change(spark, {"Amount": 1}, {"recordIds": ["a", "b"]})
    assert r.sfid == "a"


def test_rejects(spark):
    bodies = [
        "not json", "[1]", '{"a":1}', '{"ChangeEventHeader":{"changeType":"MERGE","recordIds":["a"]}}',
        '{"ChangeEventHeader":{"changeType":"create"}}',
        '{"payload":{"ChangeEventHeader":{"changeType":"create","recordIds":["a"]},"Amount":"zz"}}',
        '{"payload":{"ChangeEventHeader":{"changeType":"create","recordIds":["a"]},"Amount":"7"}}',
        "", "{}", '{"payload":null}', '{"ChangeEventHeader":"x"}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "seq long, body string")
    out = typed(normalize_changes(df, CONTACT, now()), CONTACT)
    reasons = {r.seq: r.reject_reason for r in rejected(out).collect()}
    assert reasons == {
        0: "no_payload", 1: "no_payload", 2: "no_header", 3: "change_type", 4: "no_key", 5: "bad_value:Amount",
        7: "no_payload", 8: "no_header", 9: "no_payload", 10: "change_type",
    }
    [good] = accepted(out).collect()
    assert good.vals.Amount == 7.0 and good.change_type == "CREATE"


def test_notices(spark):
    rows = [
        (1, "created", {"Id": "a", "Amount": 1, "Unknown": 2, "sfid": "x"}),
        (2, "Updated", {"Id": "a", "Fiscal": {"Year": 2024, "Quarter": 3}, "LastModifiedDate": "2024-01-01T00:00:00Z"}),
        (3, "deleted", {"Whatever": "a", "Id": "b"}),
        (4, "undeleted", {"Id": "a"}),
        (5, "created", {"Id": " "}),
        (6, "updated", {"Id": "a", "Fiscal": {"Year": 2024}, "Amount": None}),
        (7, "deleted", {}),
    ]
    df = spark.createDataFrame([(s, t, json.dumps(b)) for s, t, b in rows], "seq long, event_type string, body string")
    out = {r.seq: r for r in normalize_notices(df, CONTACT, now()).collect()}
    assert out[1].target_fields == ["Amount"] and out[1].ev is None
    assert set(out[2].target_fields) == {"Fiscal", "FiscalYear", "FiscalQuarter", "LastModifiedDate"}
    assert out[2].vals.Fiscal == "2024 3" and str(out[2].lm) == "2024-01-01 00:00:00"
    assert out[3].sfid == "a" and out[3].target_fields == [] and str(out[3].ev) == "2024-05-01 00:00:00"
    assert out[4].reject_reason == "change_type" and out[5].reject_reason == out[7].reject_reason == "no_key"
    assert out[6].target_fields == ["Amount"] and out[6].vals.Amount is None
    again = {r.seq: r for r in normalize_notices(df, CONTACT, now(), undelete=True).collect()}
    assert again[4].change_type == "UNDELETE"
