"""Request batches as JSON files: explicit schemas per operation, camelCase body names.

A request file holds one JSON object per line with the body fields of one HTTP request
(names as in the service's JSON bodies) plus ``seq`` (arrival order), ``reqTs`` (the request
time) and ``actorId`` (the signed-in user).  ``read_requests`` reads a folder of such files
with a fixed schema (no inference); malformed lines are kept in ``_corrupt_record`` and can be
rejected by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, TS, B, L = T.StringType(), T.DateType(), T.TimestampType(), T.BooleanType(), T.LongType()

_COMMON = [("seq", "seq", L), ("req_ts", "reqTs", TS), ("actor_id", "actorId", L)]
_FAMILY = [("series", "series", S), ("processor", "processor", S), ("ram", "ram", S),
           ("operating_system", "operatingSystem", S), ("charger", "charger", B),
           ("screen_resolution", "screenResolution", S), ("storage", "storage", S),
           ("os_type", "osType", S), ("imei_1", "imei1", S), ("imei_2", "imei2", S),
           ("sim_no", "simNo", S), ("phone_no", "phoneNo", S)]

# Request body fields per operation as (column, JSON name, type).
REQUEST_FIELDS: dict[str, list[tuple[str, str, T.DataType]]] = {
    "register_assets": _COMMON + [
        ("brand", "brand", S), ("model", "model", S), ("serial_no", "serialNo", S),
        ("asset_type", "AssetType", S), ("purchased_date", "purchasedDate", D),
        ("warranty_start_date", "warrantyStartDate", D),
        ("warranty_expiry_date", "warrantyExpiryDate", D), ("owned_by", "ownedBy", S),
        ("client_name", "clientName", S)] + _FAMILY,
    "update_assets": _COMMON + [
        ("id", "id", L), ("brand", "brand", S), ("model", "model", S), ("serial_no", "serialNo", S),
        ("purchased_date", "purchasedDate", D), ("warranty_start_date", "warrantyStartDate", D),
        ("warranty_expiry_date", "warrantyExpiryDate", D), ("asset_type", "AssetType", S)] + _FAMILY,
    "update_warranty": _COMMON + [
        ("asset_id", "assetId", L), ("warranty_start_date", "warrantyStartDate", D),
        ("warranty_expiry_date", "warrantyExpiryDate", D)],
    "assign_assets": _COMMON + [
        ("employee_id", "employeeID", L), ("asset_id", "assetId", L),
        ("assigned_date", "assignedDate", D)],
    "reassign_assets": _COMMON + [
        ("asset_id", "assetId", L), ("employee_id", "employeeId", L),
        ("retrieved_date", "retrievedDate", D), ("retrieval_reason", "retrievalReason", S),
        ("assigned_date", "assignedDate", S)],
    "retrieve_assets": _COMMON + [
        ("retrieved_date", "retrievedDate", D), ("retrieval_reason", "retrievalReason", S),
        ("employee_id", "employeeId", L), ("asset_id", "assetId", L)],
    "delete_assets": _COMMON + [
        ("id", "id", L), ("asset_type", "assetType", S), ("delete_reason", "deleteReason", S)],
    "asset_log": _COMMON + [
        ("operation", "operation", S), ("asset_id", "assetId", L), ("employee_id", "employeeId", L),
        ("assigned_date", "assignedDate", S), ("retrieved_date", "retrievedDate", D),
        ("retrieval_reason", "retrievalReason", S), ("asset_type", "assetType", S), ("delete_reason", "deleteReason", S),
        ("warranty_start_date", "warrantyStartDate", D), ("warranty_expiry_date", "warrantyExpiryDate", D)],
    "upsert_employees": _COMMON + [
        ("name", "name", S), ("type", "type", S), ("email", "email", S), ("phone_no", "phoneNo", S)],
    "update_employees": _COMMON + [
        ("id", "id", L), ("name", "name", S), ("type", "type", S), ("email", "email", S),
        ("phone_no", "phoneNo", S), ("status", "status", S)],
    "delete_employees": _COMMON + [
        ("employee_id", "employeeID", L), ("archive_reason", "archiveReason", S)],
    "register_users": _COMMON + [
        ("name", "name", S), ("email", "email", S), ("phone_no", "phoneNo", S),
        ("password", "password", S), ("password_hash", "passwordHash", S)],
    "update_users": _COMMON + [
        ("id", "id", L), ("name", "name", S), ("email", "email", S), ("phone_no", "phoneNo", S),
        ("password", "password", S), ("password_hash", "passwordHash", S)],
    "set_access_type": _COMMON + [("user_id", "userId", L), ("user_type", "userType", S)],
    "set_profile_image": _COMMON + [("user_id", "userId", L), ("url", "url", S)],
    "logout_users": _COMMON + [("user_id", "userId", L)],
    "login_attempts": [("seq", "seq", L), ("ts", "ts", TS), ("email", "email", S),
                       ("password_ok", "passwordOk", B)],
}


def json_schema(op: str) -> T.StructType:
    """File schema (JSON names) of ``op``'s requests, plus ``_corrupt_record``."""
    fields = [T.StructField(js, dt, True) for _, js, dt in REQUEST_FIELDS[op]]
    return T.StructType(fields + [T.StructField("_corrupt_record", S, True)])


def from_json_names(df: DataFrame, op: str) -> DataFrame:
    """Rename JSON body names to the operator's column names (keeps ``_corrupt_record``)."""
    cols = [F.col(f"`{js}`").cast(dt).alias(c) for c, js, dt in REQUEST_FIELDS[op]]
    if "_corrupt_record" in df.columns:
        cols.append(F.col("_corrupt_record"))
    return df.select(*cols)


def to_json_names(df: DataFrame, op: str) -> DataFrame:
    """Rename operator columns to JSON body names (absent columns are left out)."""
    return df.select(*[F.col(c).cast(dt).alias(js) for c, js, dt in REQUEST_FIELDS[op]
                       if c in df.columns])


def read_requests(spark: SparkSession, path: str, op: str) -> tuple[DataFrame, DataFrame]:
    """Read a folder of request files; returns (requests, malformed lines).

    PERMISSIVE mode keeps bad lines as ``_corrupt_record``; they are returned separately so
    the caller can report them as rejects instead of failing the whole batch.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", json_schema(op), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    df = from_json_names(parsed, op)
    good = df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = df.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    return good, bad


def write_requests(df: DataFrame, path: str, op: str, mode: str = "errorifexists") -> None:
    """Store a request frame as JSON lines with the body names (used to feed streams)."""
    # the default pattern would cut timestamps to milliseconds
    to_json_names(df, op).write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
