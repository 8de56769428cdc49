"""fleetbook: asset inventory analytics on Spark.

Reports and batch writes over the inventory tables, as DataFrame operators.  The commonly
used entry points are re-exported here.
"""

from fleetbook.functions.filters import ListFilter, parse_filters
from fleetbook.operators.access import (access_report, existing_users, latest_open_session,
                                        user_profile, user_status)
from fleetbook.operators.asset_writes import (assign_assets, delete_assets, reassign_assets,
                                              register_assets, retrieve_assets, set_availability,
                                              update_assets, update_warranty)
from fleetbook.operators.assets import (all_specs, asset_detail, asset_export, asset_history,
                                        asset_list, asset_list_by_status, asset_specs,
                                        assignee_history, available_picker, open_counts_by_asset)
from fleetbook.operators.dashboard import dashboard, fleet_totals, type_counts
from fleetbook.operators.employees import employee_detail, employee_list, open_counts_by_employee
from fleetbook.operators.login import login_outcomes
from fleetbook.operators.people_writes import (delete_employees, logout_users, register_users,
                                               set_access_type, set_profile_image,
                                               update_employees, update_users, upsert_employees)
from fleetbook.operators.quality import integrity_report
from fleetbook.plans.batch import Changes, apply_in_order
from fleetbook.sources.requests import read_requests
from fleetbook.sources.sinks import write_report
from fleetbook.sources.tables import Tables, load_tables, write_snapshot

__all__ = [name for name in dir() if not name.startswith("_")]
