"""The tables of a metadata store."""

from __future__ import annotations

from pyspark.sql import types as T

PIPELINE_TYPE, STAGE_TYPE = "Parent_Context", "Pipeline_Stage"
INPUT, OUTPUT = 3, 4
#: Artifact types that lineage leaves out.
NOT_LINEAGE = ("Environment", "Label")


def _struct(ddl: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "string": T.StringType(), "double": T.DoubleType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


_VALUES = "name string,is_custom_property boolean,int_value long,double_value double,string_value string,byte_value binary,proto_value binary,bool_value boolean"
_TIMES = "create_time_since_epoch long,last_update_time_since_epoch long"

TABLES: dict[str, T.StructType] = {
    "artifact": _struct(f"id long,type_id long,uri string,state int,name string,external_id string,{_TIMES}"),
    "artifactproperty": _struct(f"artifact_id long,{_VALUES}"),
    "execution": _struct(f"id long,type_id long,last_known_state int,name string,external_id string,{_TIMES}"),
    "executionproperty": _struct(f"execution_id long,{_VALUES}"),
    "context": _struct(f"id long,type_id long,name string,external_id string,{_TIMES}"),
    "type": _struct("id long,name string,version string,type_kind short,description string,input_type string,output_type string,external_id string"),
    "parentcontext": _struct("context_id long,parent_context_id long"),
    "attribution": _struct("id long,context_id long,artifact_id long"),
    "association": _struct("id long,context_id long,execution_id long"),
    "event": _struct("id long,artifact_id long,execution_id long,type int,milliseconds_since_epoch long"),
}

CONTROL_TABLES: dict[str, T.StructType] = {
    "registered_servers": _struct("id long,server_name string,host_info string,last_sync_time long"),
    "scheduled_syncs": _struct("id long,server_id long,timezone string,start_time_utc long,next_run_time_utc long,active boolean,status string,one_time boolean,created_at long,recurrence_mode string,interval_unit string,interval_value int,daily_time string,weekly_day string,weekly_time string"),
    "sync_logs": _struct("id long,schedule_id long,run_time_utc long,status string,message string,sync_type string"),
}
