"""Fetching pages on executors through a pluggable client: retries, conditional requests, per-host pace."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import urls as U
from foliant.operators.crawl import BACKOFF, FIRST_WAIT, MAX_RETRIES, RETRY_STATUSES

TIMEOUT = 30
FETCHED = "url string, seq long, http_status int, html string, etag string, last_modified string, error string, attempts int"


@dataclass
class Response:
    status: int
    text: str = ""
    etag: str | None = None
    last_modified: str | None = None


#: ``client(url, headers, timeout)`` gives a Response or raises ConnectionError or TimeoutError.
Client = Callable[[str, dict[str, str], int], Response]


def http_client(url: str, headers: dict[str, str], timeout: int) -> Response:
    """The client over the network; needs the requests package."""
    import requests

    try:
        r = requests.get(url, headers=headers, timeout=timeout)
    except requests.Timeout as e:
        raise TimeoutError(str(e)) from e
    except requests.ConnectionError as e:
        raise ConnectionError(str(e)) from e
    return Response(r.status_code, r.text, r.headers.get("ETag"), r.headers.get("Last-Modified"))


def fetch_with_retry(client: Client, url: str, headers: dict[str, str], sleep: Callable[[float], None] = time.sleep) -> tuple[Response, int]:
    """The response and how many attempts it took; a lost connection, a timeout and passing statuses are tried again
    after 2, 4 and 8 seconds, and the last failure is raised or returned."""
    wait = FIRST_WAIT
    for attempt in range(1, MAX_RETRIES + 2):
        last = attempt == MAX_RETRIES + 1
        try:
            found = client(url, headers, TIMEOUT)
            if last or found.status not in RETRY_STATUSES:
                return found, attempt
        except (ConnectionError, TimeoutError):
            if last:
                raise
        sleep(wait)
        wait *= BACKOFF
    raise AssertionError


def fetch_pages(urls: DataFrame, client: Client, headers: dict[str, str] | None = None, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Fetch (url, seq, etag, last_modified): validators go out as conditional headers, null ones don't.

    One host stays in one partition, so ``delay`` between its requests holds; hosts go in parallel. The result should
    be written once before use, since a plan that runs again fetches again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: set[str] = set()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.host in asked:
                    sleep(delay)
                asked.add(r.host)
                own = dict(headers or {})
                own |= {k: v for k, v in (("If-None-Match", r.etag), ("If-Modified-Since", r.last_modified)) if v}
                try:
                    found, attempts = fetch_with_retry(client, r.url, own, sleep)
                    bad = found.status >= 400
                    out.append((r.url, r.seq, found.status, None if bad else found.text, found.etag, found.last_modified, f"HTTP {found.status}" if bad else None, attempts))
                except Exception as e:  # noqa: BLE001 - any failure of a page is that page's result
                    out.append((r.url, r.seq, None, None, None, None, str(e) or type(e).__name__, MAX_RETRIES + 1))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FETCHED.split(", ")]).astype({"http_status": "Int32", "attempts": "Int32"})

    rows = urls.select("url", "seq", F.col("etag").cast("string").alias("etag"), F.col("last_modified").cast("string").alias("last_modified"), U.netloc(F.col("url")).alias("host"))
    return rows.repartition("host").sortWithinPartitions("host", "seq").mapInPandas(run, FETCHED)
