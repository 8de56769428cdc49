"""Explicit schemas of the inventory tables (final state after all migrations).

Columns are named after the stored column names; they are the output contract of every
operator.  ``id_type`` is ``StringType`` for production (uuid text) and ``LongType`` for the
fixtures derived from the test tables.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed domain values of the enum columns.
ASSET_TYPES = ("laptop", "mouse", "pen drive", "hard disk", "mobile", "sim")
ASSET_STATUSES = ("available", "assigned", "deleted")
OWNED_BY = ("remote_state", "client")
USER_TYPES = ("authorized", "unauthorized", "blocked")
USER_STATUSES = ("white_listed", "black_listed", "warned")
EMPLOYEE_STATUSES = ("active", "deleted", "not_an_employee")
EMPLOYEE_TYPES = ("employee", "intern", "freelancer")

# Spec family table per asset type; mouse has none.
SPEC_TABLE = {
    "laptop": "laptop_specifications",
    "pen drive": "pen_drive_specifications",
    "hard disk": "hard_disk_specifications",
    "mobile": "mobile_specifications",
    "sim": "sim_specifications",
}

# Family columns in output order.
SPEC_COLUMNS = {
    "laptop": ("series", "processor", "ram", "operating_system", "charger",
               "screen_resolution", "storage"),
    "pen drive": ("storage",),
    "hard disk": ("storage",),
    "mobile": ("os_type", "imei_1", "imei_2", "ram"),
    "sim": ("sim_no", "phone_no"),
    "mouse": (),
}

TABLE_NAMES = (
    "users", "employee", "assets", "employee_asset_relation",
    "laptop_specifications", "pen_drive_specifications", "hard_disk_specifications",
    "mobile_specifications", "sim_specifications", "sessions",
)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


def table_schema(name: str, id_type: T.DataType = T.LongType()) -> T.StructType:
    s, ts, d, b, i = T.StringType(), T.TimestampType(), T.DateType(), T.BooleanType(), T.IntegerType()
    spec_tail = [_f("created_at", ts), _f("updated_at", ts), _f("archived_at", ts)]
    fields = {
        "users": [
            _f("id", id_type, False), _f("name", s, False), _f("email", s, False),
            _f("phone_no", s, False), _f("password", s), _f("created_at", ts),
            _f("updated_at", ts), _f("archived_at", ts), _f("type", s),
            _f("authentication_times", i), _f("status", s), _f("image", s),
        ],
        "employee": [
            _f("id", id_type, False), _f("name", s, False), _f("email", s, False),
            _f("phone_no", s, False), _f("created_at", ts), _f("updated_at", ts),
            _f("archived_at", ts), _f("status", s), _f("type", s),
            _f("archive_reason", s), _f("deleted_by", id_type),
        ],
        "assets": [
            _f("id", id_type, False), _f("brand", s, False), _f("model", s, False),
            _f("serial_no", s, False), _f("asset_type", s, False),
            _f("purchased_date", d, False), _f("warranty_start_date", d, False),
            _f("warranty_expiry_date", d, False), _f("created_by", id_type),
            _f("created_at", ts), _f("updated_at", ts), _f("archived_at", ts),
            _f("is_available", b), _f("owned_by", s), _f("client_name", s),
            _f("status", s), _f("deleted_by", id_type), _f("archive_reason", s),
        ],
        "employee_asset_relation": [
            _f("id", id_type, False), _f("employee_id", id_type, False),
            _f("asset_id", id_type, False), _f("assigned_by", id_type),
            _f("assigned_date", d, False), _f("retrieved_date", d),
            _f("retrieval_reason", s), _f("created_at", ts), _f("archived_at", ts),
        ],
        "laptop_specifications": [
            _f("id", id_type), _f("asset_id", id_type, False), _f("series", s),
            _f("processor", s), _f("ram", s), _f("operating_system", s), _f("charger", b),
            _f("screen_resolution", s), _f("storage", s), *spec_tail,
        ],
        "hard_disk_specifications": [
            _f("id", id_type), _f("asset_id", id_type, False), _f("storage", s, False),
            _f("created_at", ts), _f("archived_at", ts),
        ],
        "pen_drive_specifications": [
            _f("id", id_type), _f("asset_id", id_type, False), _f("storage", s, False),
            _f("created_at", ts), _f("archived_at", ts),
        ],
        "mobile_specifications": [
            _f("id", id_type), _f("asset_id", id_type, False), _f("os_type", s),
            _f("imei_1", s), _f("imei_2", s), _f("ram", s), *spec_tail,
        ],
        "sim_specifications": [
            _f("id", id_type), _f("asset_id", id_type, False), _f("sim_no", s),
            _f("phone_no", s), *spec_tail,
        ],
        "sessions": [
            _f("id", id_type, False), _f("user_id", id_type, False), _f("start_time", ts),
            _f("end_time", ts), _f("archived_at", ts),
        ],
    }
    return T.StructType(fields[name])
