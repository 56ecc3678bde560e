"""HTTP sink: a row is a request with url, headers and body; parts of a batch are sent by a pool of threads."""

from __future__ import annotations

import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import duration_ms
from .retry import with_retries


@dataclass(frozen=True)
class HttpOptions:
    method: str
    proxy: str = ""
    timeout_s: float = 10.0
    retries: int = 1
    interval_s: float = 1.0
    threads: int = 5
    queue: int = 1024
    ignore_code: bool = False

    @staticmethod
    def of(o: dict[str, str]) -> HttpOptions:
        method = o["request.type"].upper()
        if method not in ("GET", "POST", "PUT", "DELETE"):
            raise ValueError(f"request.type {method} is none of GET, POST, PUT, DELETE")
        wait = max(duration_ms(o.get("connect.timeout", "10s")), duration_ms(o.get("read.timeout", "10s"))) / 1000
        return HttpOptions(method, o.get("proxy", ""), wait, int(o.get("retry.count", 1)), duration_ms(o.get("retry.interval", "1s")) / 1000, int(o.get("async.threads", 5)), int(o.get("async.queue.size", 1024)), o.get("code.ignore", "false") == "true")


def send(url: str, headers: dict[str, str] | None, body: bytes | None, options: HttpOptions) -> int:
    """Send a request and return the status; a status of 400 or more fails unless codes are ignored."""

    def once() -> int:
        request = urllib.request.Request(url, data=body if options.method in ("POST", "PUT", "DELETE") else None, method=options.method)
        for k, v in (headers or {}).items():
            if k is not None and v is not None:
                request.add_header(k, v)
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({"http": options.proxy, "https": options.proxy})) if options.proxy else urllib.request.build_opener()
        try:
            with opener.open(request, timeout=options.timeout_s) as reply:
                return reply.status
        except urllib.error.HTTPError as e:
            if options.ignore_code:
                return e.code
            raise

    return with_retries(once, options.retries, options.interval_s)


def write_requests(df: DataFrame, table, options: HttpOptions) -> dict[int, int]:
    """Send all rows before the batch ends; returns how many answers had each status of 400 or more (codes ignored).

    Columns by metadata: url (rows without one are skipped), headers (a map) and body.
    """
    meta = {v: k for k, v in table.metadata.items()} if table is not None and table.metadata else {}
    name = lambda key: meta.get(key, key)
    have = set(df.columns)
    headers = F.col(name("headers")) if name("headers") in have else F.lit(None).cast("map<string,string>")
    body = F.col(name("body")).cast("binary") if name("body") in have else F.lit(None).cast("binary")
    rows = df.where(F.col(name("url")).isNotNull()).select(F.col(name("url")).alias("url"), F.map_entries(headers).alias("headers"), body.alias("body"))

    def part(frames):
        with ThreadPoolExecutor(options.threads) as pool:
            for frame in frames:
                for lo in range(0, len(frame), options.queue):
                    chunk = frame.iloc[lo : lo + options.queue]
                    work = [pool.submit(send, r.url, {e["key"]: e["value"] for e in r.headers} if r.headers is not None else None, bytes(r.body) if r.body is not None else None, options) for r in chunk.itertuples()]
                    yield pd.DataFrame({"code": [w.result() for w in work]})

    counted = rows.mapInPandas(part, "code int").groupBy("code").count().collect()
    return {r["code"]: r["count"] for r in counted if r["code"] >= 400}
