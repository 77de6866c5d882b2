"""The schema of the log's actions, one nullable struct for each kind."""

from __future__ import annotations

import json

from pyspark.sql.types import StructType

_DV = "struct<storageType:string,pathOrInlineDv:string,offset:int,sizeInBytes:int,cardinality:bigint>"
_MAP = "map<string,string>"
KINDS = {
    "add": f"struct<path:string,partitionValues:{_MAP},size:bigint,modificationTime:bigint,dataChange:boolean,stats:string,tags:{_MAP},deletionVector:{_DV},baseRowId:bigint,defaultRowCommitVersion:bigint,clusteringProvider:string>",
    "remove": f"struct<path:string,deletionTimestamp:bigint,dataChange:boolean,extendedFileMetadata:boolean,partitionValues:{_MAP},size:bigint,stats:string,tags:{_MAP},deletionVector:{_DV},baseRowId:bigint,defaultRowCommitVersion:bigint>",
    "cdc": f"struct<path:string,partitionValues:{_MAP},size:bigint,dataChange:boolean,tags:{_MAP}>",
    "metaData": f"struct<id:string,name:string,description:string,format:struct<provider:string,options:{_MAP}>,schemaString:string,partitionColumns:array<string>,createdTime:bigint,configuration:{_MAP}>",
    "protocol": "struct<minReaderVersion:int,minWriterVersion:int,readerFeatures:array<string>,writerFeatures:array<string>>",
    "commitInfo": f"struct<timestamp:bigint,inCommitTimestamp:bigint,operation:string,operationParameters:{_MAP},kernelVersion:string,isBlindAppend:boolean,engineInfo:string,txnId:string>",
    "txn": "struct<appId:string,version:bigint,lastUpdated:bigint>",
    "domainMetadata": "struct<domain:string,configuration:string,removed:boolean>",
    "sidecar": f"struct<path:string,sizeInBytes:bigint,modificationTime:bigint,tags:{_MAP}>",
    "checkpointMetadata": f"struct<version:bigint,tags:{_MAP}>",
}


def schema(*kinds: str) -> StructType:
    """A schema with the kinds asked for, or all."""
    return StructType.fromDDL(", ".join(f"{k} {KINDS[k]}" for k in kinds or KINDS))


def line(kind: str, **fields) -> str:
    """One action as a line of a commit; fields that are None are left out, but not None values in maps."""
    return json.dumps({kind: {k: v for k, v in fields.items() if v is not None}}, separators=(",", ":"))
