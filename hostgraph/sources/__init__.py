from .tables import read_table, TABLES  # noqa: F401
from .flows import (  # noqa: F401
    events_flows, lineitem_flows, raw_flows, FLOW_COLUMNS, ATTACK_LABEL, PATIENT_ZERO_ID,
)
