from .columns import (  # noqa: F401
    bucket_floor, parse_ambiguous_timestamp, binary_label, is_internal_ip,
    fix_label_encoding, inf_to_null, host_name, BENIGN,
)
