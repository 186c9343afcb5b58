"""DataFrame -> DataFrame operators."""

from gaugeline.operators.numbering import number_rows  # noqa: F401
from gaugeline.operators.partitioning import with_partition, partition_balance  # noqa: F401
from gaugeline.operators.query import (  # noqa: F401
    count_records, list_uuids, page_all, page_meta, page_meta_all, recent_records, records_after,
    records_page, select_records, telemetry_by_uuid,
)
from gaugeline.operators.parse import parse_records, valid, rejects, reject_counts  # noqa: F401
