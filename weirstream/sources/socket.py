"""Socket source: lines of a TCP server, by Spark's own source, or with another delimiter by a Python data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class DelimitedSocketReader(SimpleDataSourceStreamReader):
    """Reads what a server has sent so far, split at a byte; connects again when the line breaks. Not fault tolerant."""

    def __init__(self, options):
        self.address = (options.get("hostname", "localhost"), int(options.get("port", 9999)))
        self.delimiter = bytes([int(options.get("byte-delimiter", 10))])
        self.link, self.rest, self.count, self.kept = None, b"", 0, {}

    def initialOffset(self):
        return {"n": 0}

    def read(self, start):
        import socket

        lines = []
        try:
            if self.link is None:
                self.link = socket.create_connection(self.address, timeout=1)
                self.link.settimeout(0.2)
            while len(lines) < 10_000:
                data = self.link.recv(1 << 16)
                if not data:
                    self.link = None
                    break
                *done, self.rest = (self.rest + data).split(self.delimiter)
                lines += done
        except TimeoutError:
            pass
        except OSError:
            self.link = None  # the next batch connects again
        end = {"n": start["n"] + len(lines)}
        rows = [(x.decode("utf-8", "replace"),) for x in lines]
        self.kept[(start["n"], end["n"])] = rows
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        return iter(self.kept.get((start["n"], end["n"]), []))


class DelimitedSocket(DataSource):
    @classmethod
    def name(cls):
        return "delimited_socket"

    def schema(self):
        return "value string"

    def simpleStreamReader(self, schema):
        return DelimitedSocketReader(self.options)


def socket_lines(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    host, port = options.get("hostname", "localhost"), options.get("port", "9999")
    if options.get("byte-delimiter", "10") == "10":
        return spark.readStream.format("socket").option("host", host).option("port", port).load()
    spark.dataSource.register(DelimitedSocket)
    return spark.readStream.format("delimited_socket").options(**{k: v for k, v in options.items() if k in ("hostname", "port", "byte-delimiter")}).load()
