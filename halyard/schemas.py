"""Fixed schemas; nothing is inferred in production paths."""

from __future__ import annotations

STATS = "struct<avg:double,min:double,max:double,unit:struct<base:string,prefix:string>>"
#: A job document of the archive.
JOB_META = (
    "jobId long, cluster string, subCluster string, user string, project string, partition string, shared string, jobState string, arrayJobId long, smt int, "
    "startTime long, stopTime long, duration long, walltime long, numNodes long, numHwthreads long, numAcc long, energy double, "
    "resources array<struct<hostname:string,hwthreads:array<int>,accelerators:array<string>,configuration:string>>, "
    f"statistics map<string,{STATS}>, tags array<struct<type:string,name:string,scope:string>>, metaData map<string,string>, "
    "footprint map<string,double>, energyFootprint map<string,double>"
)
SERIES = "struct<hostname:string,id:string,statistics:struct<avg:double,min:double,max:double>,data:array<double>>"
JOB_DATA = f"map<string,map<string,struct<unit:struct<base:string,prefix:string>,timestep:long,series:array<{SERIES}>>>>"
METRICS = "map<string,struct<data:array<double>,frequency:long,start:long>>"
#: One level of a checkpoint; children stay text until they are parsed in their turn.
CHECKPOINT = f"struct<`from`:long,`to`:long,metrics:{METRICS},children:map<string,string>>"
_LIMITS = "name:string,peak:double,normal:double,caution:double,alert:double,footprint:string,energy:string,lowerIsBetter:boolean,remove:boolean"
CLUSTER = (
    "name string, subClusters array<struct<name:string,nodes:string,socketsPerNode:int,coresPerSocket:int,threadsPerCore:int,"
    "topology:struct<node:array<int>,socket:array<array<int>>,memoryDomain:array<array<int>>,core:array<array<int>>>>>, "
    f"metricConfig array<struct<{_LIMITS},unit:struct<base:string,prefix:string>,scope:string,aggregation:string,timestep:int,restrict:boolean,subClusters:array<struct<{_LIMITS}>>>>"
)
JOB_EVENT = (
    "struct<jobId:long,cluster:string,subCluster:string,user:string,project:string,partition:string,shared:string,jobState:string,startTime:long,stopTime:long,"
    "walltime:long,numNodes:long,numHwthreads:long,numAcc:long,resources:array<struct<hostname:string>>>"
)
#: Columns of a job row that are stored as JSON text.
JSON_COLUMNS = {
    "resources": "array<struct<hostname:string,hwthreads:array<int>,accelerators:array<string>,configuration:string>>",
    "statistics": f"map<string,{STATS}>",
    "tags": "array<struct<type:string,name:string,scope:string>>",
    "meta_data": "map<string,string>",
    "footprint": "map<string,double>",
    "energy_footprint": "map<string,double>",
}
