"""The external review table: reading corrections, writing exports, both also without a network.

``review_table`` is a Python data source. Its option ``path`` names a JSON file
of response bodies, or ``url`` with ``token`` an HTTP service. The filter on
rows in need of review is pushed to the source; Spark asks for
``spark.sql.python.filterPushdown.enabled`` to be true for that.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter

from mnemograph.operators.graph import export_rows

_RUNS = "array<struct<plain_text:string>>"
RESPONSE = f"results array<struct<id:string, properties:struct<`Name`:struct<title:{_RUNS}>, `Correction Notes`:struct<rich_text:{_RUNS}>>>>"
SCHEMA = "page_id string, subject_name string, correction_notes string, needs_review boolean"


def parse_review_rows(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(page_id, subject_name, correction_notes) of JSON response bodies; results without id or properties go."""

    def runs(c: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(c, lambda r: r["plain_text"]), ""), F.lit(""))

    r = bodies.select(F.explode(F.from_json(body, RESPONSE)["results"]).alias("r")).select("r.*").where("id is not null and properties is not null")
    return r.select(
        F.col("id").alias("page_id"),
        runs(F.col("properties")["Name"]["title"]).alias("subject_name"),
        runs(F.col("properties")["Correction Notes"]["rich_text"]).alias("correction_notes"),
    )


def query_body() -> str:
    """Request for the rows in need of review."""
    return json.dumps({"filter": {"property": "Needs Review", "checkbox": {"equals": True}}})


def page_bodies(rows: DataFrame, database_id: str) -> DataFrame:
    """One JSON request body, ``body``, for each export row; times in UTC."""

    def text(c: Column) -> Column:
        return F.array(F.struct(F.struct(c.alias("content")).alias("text")))

    when = F.date_format(F.to_utc_timestamp("valid_from", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    properties = F.struct(
        F.struct(text(F.col("subject_name")).alias("title")).alias("Name"),
        F.struct(text(F.col("kind")).alias("rich_text")).alias("Kind"),
        F.struct(text(F.col("fact_text")).alias("rich_text")).alias("Fact"),
        F.struct(F.struct(when.alias("start")).alias("date")).alias("Valid From"),
        F.struct(F.col("needs_review").alias("checkbox")).alias("Needs Review"),
        F.struct(text(F.col("correction_notes")).alias("rich_text")).alias("Correction Notes"),
    )
    parent = F.struct(F.lit(database_id).alias("database_id"))
    return rows.select(F.to_json(F.struct(parent.alias("parent"), properties.alias("properties"))).alias("body"))


def database_body(parent_page: str, title: str = "Memory") -> str:
    """Request that creates the table."""
    columns = {"Name": "title", "Kind": "rich_text", "Fact": "rich_text", "Valid From": "date", "Needs Review": "checkbox", "Correction Notes": "rich_text"}
    return json.dumps({"parent": {"type": "page_id", "page_id": parent_page}, "title": [{"type": "text", "text": {"content": title}}], "properties": {n: {k: {}} for n, k in columns.items()}})


def all_pages(send: Callable[[str, str, str], str], path: str, body: dict) -> Iterator[dict]:
    """Results of a query over all its pages."""
    cursor = None
    while True:
        answer = json.loads(send("POST", path, json.dumps(body | ({"start_cursor": cursor} if cursor else {}))))
        yield from answer.get("results", [])
        cursor = answer.get("next_cursor") if answer.get("has_more") else None
        if not cursor:
            return


def clear_body() -> str:
    """Request that marks a row as reviewed."""
    return json.dumps({"properties": {"Needs Review": {"checkbox": False}}})


def http_post(url: str, token: str, version: str) -> Callable[[str, str, str], str]:
    """(method, path, body) -> response body; the token goes into a header only."""
    from urllib.request import Request, urlopen

    def send(method: str, path: str, body: str) -> str:
        headers = {"Authorization": f"Bearer {token}", "Content-Type": "application/json", "Notion-Version": version}
        with urlopen(Request(f"{url}{path}", body.encode(), headers, method=method), timeout=60) as answer:  # noqa: S310
            return answer.read().decode()

    return send


def export(facts: DataFrame, entities: DataFrame, parent_page: str, send: Callable[[str, str, str], str]) -> str:
    """A new table with a row for each active fact of a known subject; its id.

    Rows are sent one after another from the driver, as the service takes a few
    requests a second in all; :func:`send_rows` sends them from the executors.
    """
    database = json.loads(send("POST", "/databases", database_body(parent_page))).get("id") or ""
    for row in page_bodies(export_rows(facts, entities), database).toLocalIterator():
        send("POST", "/pages", row["body"])
    return database


def send_rows(bodies: DataFrame, connect: Callable[[], Callable[[str, str, str], str]]) -> None:
    """One request for each ``body``, from the tasks that hold them; ``connect`` gives a sender in each task."""

    def run(rows: Iterator) -> None:
        send = connect()
        for r in rows:
            send("POST", "/pages", r["body"])

    bodies.foreachPartition(run)


class ReviewTable(DataSource):
    """``spark.read.format("review_table")``."""

    @classmethod
    def name(cls) -> str:
        return "review_table"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ReviewReader(dict(self.options))


class ReviewReader(DataSourceReader):
    """The source has no partitions; its answers come page by page, each naming where the next begins."""

    def __init__(self, options: dict):
        self.options, self.only_open = options, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("needs_review",) and f.value is True:
                self.only_open = True
            else:
                yield f

    def results(self) -> Iterator[dict]:
        """The rows of all pages; a file is one page."""
        if "path" in self.options:
            with open(self.options["path"], encoding="utf-8") as f:
                yield from json.load(f).get("results", [])
            return
        send = http_post(self.options["url"], self.options["token"], self.options.get("version", "2022-06-28"))
        yield from all_pages(send, f"/databases/{self.options['database']}/query", json.loads(query_body()) if self.only_open else {})

    def read(self, partition) -> Iterator[tuple]:
        for r in self.results():
            if not r.get("id") or not isinstance(r.get("properties"), dict):
                continue
            p = r["properties"]
            text = lambda name, kind, p=p: "".join(x.get("plain_text", "") for x in (p.get(name) or {}).get(kind) or [])
            needs = bool((p.get("Needs Review") or {}).get("checkbox", True))
            if needs or not self.only_open:
                yield r["id"], text("Name", "title"), text("Correction Notes", "rich_text"), needs
