"""Fixed names of result columns and labels: fixed values, part of the interface."""

SIZE_COLUMN = "size"
NUM_RECORDS_COLUMN = "stats.numRecords"
PARTITION_COLUMN = "partitionValues"
NUM_RECORDS_COLUMNS = ["partitionValues", "num_of_parquet_files", "mean_num_records_in_files", "stddev", "min_num_records", "max_num_records", "Percentile[10th, 25th, Median, 75th, 90th, 95th]"]
SIZE_COLUMNS = ["partitionValues", "num_of_parquet_files", "mean_size_of_files", "stddev", "min_file_size", "max_file_size", "Percentile[10th, 25th, Median, 75th, 90th, 95th]"]
OVERALL = "OVERALL RESOLVED CONDITION =>"
MIN_MAX = "GREATER THAN / LESS THAN PART =>"
EQUALS = "EQUALS/EQUALS NULL SAFE PART =>"
LEFT_OVER = "LEFT OVER PART =>"
UNRESOLVED = "UNRESOLVED PART =>"
TOTAL_NUM_FILES = "TOTAL_NUM_FILES_IN_DELTA_TABLE =>"
UNRESOLVED_COLS = "UNRESOLVED_COLUMNS =>"
PERCENTAGES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
CHANGE_FEED_PROPERTY = "delta.enableChangeDataFeed"
METRIC_COLUMNS = ["version", "deleted", "inserted", "updated", "source_rows"]


def format_sql(conjuncts: list[str]) -> str:
    """SQL of a class of conjuncts, ``Empty`` if there is none."""
    return " and ".join(conjuncts) if conjuncts else "Empty"
