"""Declared schemas of the tables the library reads."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


S, D, L, B = StringType(), DoubleType(), LongType(), BooleanType()

RUNS_CSV = _struct(iteration=S, rep=S, system=S, run_name=S, phase=S, makespan=S, makespan_s=S, wall_s=S)
CELLS_CSV = _struct(rep=S, system=S, run_name=S, phase=S, makespan_s=S, wall_s=S, report_ok=S)
FLOW = _struct(fromTask=S, toTask=S, srcNode=S, dstNode=S, dataSize=L, startUnix=D, endUnix=D, ok=B)
DOC = _struct(doc_id=S, text=S)
QUERY = _struct(query_id=S, text=S)

TWO_HOP = _struct(
    run_name=S, producer_pod=S, consumer_pod=S,
    producer_log=_struct(role=S, pod=S, node=S, t0_wall=D, t1_wall=D, t1p_wall=D, bytes=L),
    consumer_log=_struct(role=S, pod=S, node=S, t3_wall=D, t_found_wall=D, t4_wall=D, bytes=L, expected_bytes=L,
                         ok=B, poll_s=D),
    pod_api=_struct(producer_started=S, producer_finished=S, consumer_started=S, consumer_finished=S),
    _corrupt_record=S)

AGENT_METRICS = _struct(
    node=S, uptime_seconds=L, goroutines=L,
    memory=_struct(alloc_bytes=L, sys_bytes=L),
    disk=_struct(bytes_used=L, run_count=L),
    transfers=_struct(put_total=L, put_ok=L, put_checksum_mismatch=L, put_conflict=L, put_idempotent=L, bytes_in=L),
    push=_struct(attempts=L, success=L, failed=L, inflight=L, bytes_out=L))

TASK_SPEC = _struct(
    name=S, image=S, dependencies=ArrayType(S), dataSize=S, runtime=D,
    resources=_struct(cpu=S, memory=S), constraints=_struct(nodeNames=ArrayType(S)),
    runtimeProfile=MapType(S, D))
TASK_STATUS = _struct(name=S, phase=S, state=S, node=S, startTime=S, completionTime=S, sending=B, dataSize=S)
PREDICTED_TASK = _struct(name=S, node=S, estStart=D, estEnd=D)
RUN_FLOW = _struct(fromTask=S, toTask=S, srcNode=S, dstNode=S, start=D, end=D, dataSize=L, ok=B)
RUN_DOCUMENT = _struct(
    metadata=_struct(name=S, namespace=S, uid=S, creationTimestamp=S),
    spec=_struct(tasks=ArrayType(TASK_SPEC)),
    status=_struct(phase=S, makespan=D, tasks=ArrayType(TASK_STATUS), predictedTasks=ArrayType(PREDICTED_TASK),
                   predictedNetworkFlows=ArrayType(RUN_FLOW), actualNetworkFlows=ArrayType(RUN_FLOW)))

DETECTION = _struct(camera=S, frame=S, det_index=IntegerType(), bbox=ArrayType(D), score=D,
                    class_id=IntegerType())
