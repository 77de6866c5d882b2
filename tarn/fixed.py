"""Fixed values of the table format: names, numbers and patterns that must be as they are for tables to be read alike."""

LOG_DIR = "_delta_log"
SIDECAR_DIR = "_sidecars"
STAGED_DIR = "_staged_commits"
CHANGE_DIR = "_change_data"
LAST_CHECKPOINT = "_last_checkpoint"

# File names in the log.
COMMIT = r"^(\d{20})\.json$"
STAGED = r"^(\d{20})\.([0-9a-fA-F-]{36})\.json$"
CLASSIC = r"^(\d{20})\.checkpoint\.parquet$"
UUID_CHECKPOINT = r"^(\d{20})\.checkpoint\.([0-9a-fA-F-]{36})\.(json|parquet)$"
MULTI_PART = r"^(\d{20})\.checkpoint\.(\d{10})\.(\d{10})\.parquet$"
COMPACTED = r"^(\d{20})\.(\d{20})\.compacted\.json$"
CHECKSUM = r"^(\d{20})\.crc$"

# Deletion vectors.
DV_MAGIC = 1681511377
DV_FILE_VERSION = 1
Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"

# Statistics.
STRING_STAT_CHARS = 32
DEFAULT_INDEXED_COLUMNS = 32
HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"

# Field metadata.
MAPPING_ID = "delta.columnMapping.id"
MAPPING_NAME = "delta.columnMapping.physicalName"
CURRENT_DEFAULT = "CURRENT_DEFAULT"
INVARIANTS = "delta.invariants"

# Table properties.
FEATURE_PREFIX = "delta.feature."
P_APPEND_ONLY = "delta.appendOnly"
P_CDF = "delta.enableChangeDataFeed"
P_DV = "delta.enableDeletionVectors"
P_MAPPING = "delta.columnMapping.mode"
P_MAX_ID = "delta.columnMapping.maxColumnId"
P_ROW_TRACKING = "delta.enableRowTracking"
P_ROW_ID_COLUMN = "delta.rowTracking.materializedRowIdColumnName"
P_ICT = "delta.enableInCommitTimestamps"
P_ICT_VERSION = "delta.inCommitTimestampEnablementVersion"
P_ICT_TIME = "delta.inCommitTimestampEnablementTimestamp"
P_WIDENING = "delta.enableTypeWidening"
P_CHECKPOINT_POLICY = "delta.checkpointPolicy"
P_STATS_JSON = "delta.checkpoint.writeStatsAsJson"
P_STATS_STRUCT = "delta.checkpoint.writeStatsAsStruct"
P_INDEXED = "delta.dataSkippingNumIndexedCols"
P_STATS_COLUMNS = "delta.dataSkippingStatsColumns"
P_TOMBSTONES = "delta.deletedFileRetentionDuration"
P_TXN_RETENTION = "delta.setTransactionRetentionDuration"
P_ICEBERG_V3 = "delta.enableIcebergCompatV3"

# Domains.
ROW_TRACKING_DOMAIN = "delta.rowTracking"
CLUSTERING_DOMAIN = "delta.clustering"
SYSTEM_DOMAIN_PREFIX = "delta."

# Features that readers and writers know, and where each is supported: scan, change feed, write.
READER_FEATURES = {
    "columnMapping": ("scan", "cdf", "write"),
    "deletionVectors": ("scan", "cdf", "write"),
    "timestampNtz": ("scan", "cdf", "write"),
    "typeWidening": ("scan", "cdf"),
    "typeWidening-preview": ("scan", "cdf"),
    "v2Checkpoint": ("scan", "cdf", "write"),
    "vacuumProtocolCheck": ("scan", "cdf", "write"),
    "variantType": ("scan", "write"),
    "variantType-preview": ("scan", "write"),
    "variantShredding-preview": ("scan",),
    "catalogManaged": ("scan", "write"),
    "catalogOwned-preview": ("scan", "write"),
    "geospatial": ("scan",),
}
WRITER_FEATURES = {
    "appendOnly": True,
    "invariants": True,
    "changeDataFeed": True,
    "domainMetadata": True,
    "rowTracking": True,
    "inCommitTimestamp": True,
    "clustering": True,
    "allowColumnDefaults": True,
    "icebergCompatV1": False,
    "icebergCompatV2": False,
    "icebergCompatV3": True,
    "materializePartitionColumns": True,
    "checkConstraints": False,
    "generatedColumns": False,
    "identityColumns": False,
}

# How statistics spell times: written to the millisecond, read to the nanosecond.
STATS_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
STATS_READ_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX]"}
