"""Macros that scripts expand: table options, settings, function sets. Their names, parameters and defaults are fixed values
that existing scripts rely on."""

from __future__ import annotations

from dataclasses import dataclass, field

#: What templates take from the environment unless a run sets it.
DEFAULTS = {
    "kafka.properties.bootstrap.servers": "localhost:9092",
    "socket.hostname": "localhost",
    "elasticsearch.hosts": "http://localhost:9200",
    "hbase.zookeeper.quorum": "localhost:2181",
    "paimon.warehouse": "file:///tmp/paimon",
}


@dataclass
class Macro:
    """A macro's needs, its defaults (@name takes an environment value) and how its text is made."""

    kind: str  # table, settings or functions
    fixed: dict[str, str] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    open: bool = False  # takes any further keys
    prefix: str = ""
    functions: tuple[str, ...] = ()
    drop_empty: tuple[str, ...] = ()

    def expand(self, given: dict[str, str], environment: dict[str, str]) -> str:
        missing = [k for k in self.needs if k not in given]
        extra = [k for k in given if k not in self.needs and k not in self.defaults]
        if missing or (extra and not self.open):
            raise ValueError(f"macro parameters missing: {missing}, unknown: {extra if not self.open else []}")
        values = {k: environment[v[1:]] if v.startswith("@") else v for k, v in self.defaults.items()} | given
        values = {k: v for k, v in values.items() if v or k not in self.drop_empty}
        if self.kind == "table":
            pairs = ",\n".join(f"'{k}' = '{v}'" for k, v in (self.fixed | values).items())
            return f"WITH (\n{pairs}\n);"
        lines = [f"SET '{self.prefix}{k}' = '{v}';" for k, v in values.items()]
        return "\n".join([*lines, *[f"CREATE TEMPORARY FUNCTION IF NOT EXISTS {f} AS 'weirstream.{f}' LANGUAGE PYTHON;" for f in self.functions]])


def _table(connector: str, *needs: str, more: bool = False, drop: tuple[str, ...] = (), **defaults: str) -> Macro:
    return Macro("table", {"connector": connector}, needs, {k.replace("__", "-").replace("_", "."): v for k, v in defaults.items()}, more, drop_empty=drop)


MACROS = {
    "table_kafka_source": _table("kafka", "topic", more=True, properties_bootstrap_servers="@kafka.properties.bootstrap.servers", scan_startup_mode="latest-offset", format="json"),
    "table_kafka_sink": _table(
        "kafka", "topic", more=True, format="json", properties_bootstrap_servers="@kafka.properties.bootstrap.servers", properties_acks="1", properties_compression_type="zstd",
        properties_linger_ms="100", properties_buffer_memory="262144000", properties_batch_size="122880", sink_partitioner="default",
    ),
    "table_socket_source": _table("socket", hostname="@socket.hostname", port="9999", byte__delimiter="10", format="json"),
    "table_http_sink": _table(
        "http", "request.type", proxy="", connect_timeout="10s", read_timeout="10s", retry_interval="1s", retry_count="1", async_queue_size="1024", async_threads="5", sink_parallelism="1", code_ignore="false",
        drop=("proxy",),
    ),
    "table_print_sink": _table("print"),
    "table_elasticsearch6_sink": _table("elasticsearch-6", "index", "document-type", more=True, hosts="@elasticsearch.hosts"),
    "table_hbase2_sink": _table("hbase-2.2", "table-name", more=True, zookeeper_quorum="@hbase.zookeeper.quorum", zookeeper_znode_parent="", drop=("zookeeper.znode.parent",)),
    "table_doris_sink": _table("doris", "fenodes", "table.identifier", more=True, username="root", password="", drop=("password",)),
    "table_parquet": _table("parquet", "path", more=True),
    "catalog_paimon": _table("paimon", more=True, warehouse="@paimon.warehouse"),
    "setting_restart_strategy_policy": Macro("settings", prefix="restart-strategy.", defaults={"type": "fixed-delay", "fixed-delay.attempts": "2147483647", "delay": "10 s"}),
    "setting_table": Macro("settings", prefix="table.", defaults={"exec.state.ttl": "4 min"}, open=True),
    "setting_checkpointing": Macro("settings", prefix="execution.checkpointing.", defaults={"mode": "EXACTLY_ONCE", "interval": "2 min", "timeout": "2 min", "min-pause": "2 s"}, open=True),
    "udf_time": Macro("functions", functions=("to_timestamp", "to_long_timestamp", "to_date", "to_hour")),
    "udf_statistics": Macro(
        "functions", prefix="jobparam.", functions=("percentile_temporary", "percentile", "hyper_log_log_temporary", "hyper_log_log"),
        defaults={"percentile.compression": "100", "percentile.compression.temporary": "100", "hyperloglog.number.slot": "4096", "hyperloglog.number.per.slot": "8"},
    ),
    "udf_math": Macro("functions", prefix="jobparam.", defaults={"hashcode.seed": "12331233"}, functions=("hash_code", "modular")),
    "udf_basic": Macro("functions", functions=("line_separator",)),
    "udf_session_value": Macro("functions", functions=tuple(f"session_{k}_collect" for k in ("bool", "byte", "int", "long", "short", "string", "float", "double", "binary"))),
}
