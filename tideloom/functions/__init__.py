from .columns import (
    add_date_parts,
    conform_to,
    content_order,
    is_on,
    merged_schema,
    sanitize_columns,
)
from .maps import merge_maps, option_or, prefix_keys, present_options
from .ordering import is_later, order_latest_first, ordering_columns
from .text import (
    activation,
    bucket_of,
    dead_letter_name,
    decode_object_key,
    event_name,
    iso_now,
    queue_name,
    rule_name,
    schedule_expression,
)

__all__ = [
    "activation",
    "add_date_parts",
    "bucket_of",
    "conform_to",
    "content_order",
    "dead_letter_name",
    "decode_object_key",
    "event_name",
    "is_later",
    "is_on",
    "iso_now",
    "merge_maps",
    "merged_schema",
    "option_or",
    "order_latest_first",
    "ordering_columns",
    "prefix_keys",
    "present_options",
    "queue_name",
    "rule_name",
    "sanitize_columns",
    "schedule_expression",
]
