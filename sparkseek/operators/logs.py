"""Query logs, history, agent decisions and workflows, as set operations."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.functions import text as X


def popular_queries(log: DataFrame, n: int = 5, ring: int = 100) -> DataFrame:
    """Most frequent of the last ``ring`` entries of ``log(at, query)``; ties go to the one seen first."""
    last = log.where(F.trim("query") != "").orderBy(F.desc("at")).limit(ring)
    return last.groupBy("query").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy(F.desc("n"), "first").limit(n).select("query", "n")


def click_popularity(log: DataFrame) -> DataFrame:
    """Clicks by query and record; queries count in folded lower case."""
    return log.where("record_id IS NOT NULL").groupBy(X.fold(F.lower(F.trim("query"))).alias("query"), "record_id").agg(F.count("*").alias("count"))


def history(entries: DataFrame, most: int = 50) -> DataFrame:
    """Newest entry of each query, pinned ones first, at most ``most``."""
    rows = entries.groupBy(F.trim("query").alias("query")).agg(F.max("ts").alias("ts"), F.max("pinned").alias("pinned")).where("query <> ''")
    return rows.orderBy(F.desc("pinned"), F.desc("ts"), "query").limit(most)


def history_suggestions(entries: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    return history(entries).where(F.lower("query").startswith(prefix.lower())).orderBy(F.desc("pinned"), F.desc("ts"), "query").limit(limit).select("query")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rankings ``(id, score)`` side by side."""
    return a.select("id", F.col("score").alias("first")).join(b.select("id", F.col("score").alias("second")), "id", "full")


def debounced(events: DataFrame, gap: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Bursts of events without a pause of ``gap``: one re-index each."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("event_type")).alias("kinds")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.array_join("kinds", ",").alias("kinds"))


def rate_limited(events: DataFrame, most: int, seconds: int, key: str = "user_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Events that are admitted at no more than ``most`` in any ``seconds``, by key, with ``recent``, how many of these were.

    Events that are refused do not count against later ones, so each key is walked in order of time; a task keeps
    the last ``most`` admitted times of one key and no more. The events of one key are in one task.
    """
    ms = F.unix_millis("ts")
    dealt = events.withColumn("_ms", ms).repartition(F.col(key)).sortWithinPartitions(key, "_ms", *order)
    width = seconds * 1000

    def admitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times = object(), deque()
        for frame in frames:
            recent = np.zeros(len(frame), np.int64)
            for i, (k, t) in enumerate(zip(frame[key].tolist(), frame["_ms"].tolist(), strict=True)):
                if k != current:
                    current, times = k, deque()
                while times and times[0] <= t - width:
                    times.popleft()
                if len(times) < most:
                    times.append(t)
                    recent[i] = len(times)
            out = frame[recent > 0].drop(columns="_ms")
            yield out.assign(recent=recent[recent > 0])

    schema = T.StructType([*events.schema.fields, T.StructField("recent", T.LongType())])
    return dealt.mapInPandas(admitted, schema)


def latest_by(rows: DataFrame, keys: list[str], order: list[str], place: list[str] | None = None) -> DataFrame:
    """The last row of each key, at the place of its first: one partial aggregate."""
    row = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.struct(*order)).alias("r"), F.min(F.struct(*(place or order))).alias("place")).select("r.*", "place")


def manifest(records: DataFrame, sensitive: str = r"(?i)password|card|ssn|social-security|cc-", navigate_only: bool = False, exclude: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Records without sensitive or excluded selectors, once for each type, heading and selector (the last, at the first's place), within ``by``."""
    selector = F.coalesce("selector", F.lit(""))
    kept = records.where(~selector.rlike(sensitive))
    for part in exclude:
        kept = kept.where(~selector.contains(part))
    if navigate_only:
        kept = kept.withColumn("destructive", (F.col("type") == "action") | F.coalesce("destructive", F.lit(False)))
    kept = kept.withColumn("target", F.coalesce(F.nullif("selector", F.lit("")), "url"))
    return latest_by(kept, [*by, "type", "heading", "target"], ["seq"]).drop("target")


def manifest_counts(records: DataFrame, page: str = "url", **knobs) -> DataFrame:
    """``page, records, kept, excluded`` of the manifest of each page; repeats count as excluded."""
    kept = manifest(records, by=[page], **knobs).groupBy(page).agg(F.count("*").alias("kept"))
    every = records.groupBy(page).agg(F.count("*").alias("records"))
    n = F.coalesce("kept", F.lit(0))
    return every.join(kept, page, "left").select(F.col(page).alias("page"), "records", n.alias("kept"), (F.col("records") - n).alias("excluded"))


def reweighted(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores of ``rows(type, score)`` times the weight of their type, none below 0; 1 where there is no weight."""
    w = F.lit(1.0)
    for kind, v in weights.items():
        w = F.when(F.col("type") == kind, F.lit(max(0.0, float(v)))).otherwise(w)
    return rows.withColumn("score", F.col("score") * w)


def gate(requests: DataFrame, records: DataFrame, execute: bool = False) -> DataFrame:
    """Why ``requests(id, kind)`` may not act on their record: ``reason`` is null where they may."""
    known = records.withColumn("known", F.lit(True)).select("id", "known", "type", "destructive", "selector")
    act = F.when((F.col("type") == "action") & F.coalesce("destructive", F.lit(False)) & F.lit(not execute), "blocked-destructive")
    fill = F.when(F.col("type") != "field", "not-a-field").when(F.coalesce("selector", F.lit("")) == "", "no-selector")
    reason = F.when(F.col("known").isNull(), "not-found").when(F.col("kind") == "act", act).otherwise(fill)
    return requests.join(known, "id", "left").select("id", "kind", reason.isNull().alias("success"), reason.alias("reason"))


def interactive(records: DataFrame) -> DataFrame:
    return records.where(F.col("type").isin("action", "field"))


def agent_tools(records: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("heading", F.lit("")), F.nullif("label", F.lit("")), "id")
    return interactive(records).select("id", "type", name.alias("name"), F.coalesce("body", F.lit("")).alias("description"), "selector")


def actionable(records: DataFrame, text: str) -> DataFrame:
    """The first action or field whose heading or label holds a text."""
    t = text.lower()
    hit = F.lower("heading").contains(t) | F.coalesce(F.lower("label").contains(t), F.lit(False))
    return interactive(records).where(hit).orderBy("seq").limit(1)


STEP = "action string, selector string, record_id string, value string, url string, timeout int"


def parse_workflow(yaml: str) -> list[dict]:
    """Steps of the small YAML subset: a list of mappings that begin with ``- action:``."""
    names = {"selector": "selector", "recordId": "record_id", "value": "value", "url": "url", "timeout": "timeout"}
    steps: list[dict] = []
    for line in map(str.strip, yaml.split("\n")):
        if m := re.match(r"- action:\s*(\w+)", line):
            steps.append({"action": m[1]})
        elif steps and not line.startswith("#") and (m := re.match(r'(\w+):\s*"?([^"]*?)"?\s*$', line)) and m[1] in names and m[2]:
            steps[-1][names[m[1]]] = int(m[2]) if m[1] == "timeout" else m[2].strip()
    return steps


def workflow_errors(steps: DataFrame) -> DataFrame:
    """``workflow, step, error`` for ``steps(workflow, step, action, ...)``."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    what = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(" ("), F.col("action"), F.lit("): missing "))
    checks = F.array(
        F.when(empty("action"), F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(': missing "action"'))),
        F.when(F.col("action").isin("click", "type", "submit", "extract") & empty("selector") & empty("record_id"), F.concat(what, F.lit('"selector" or "recordId"'))),
        F.when((F.col("action") == "type") & empty("value"), F.concat(what, F.lit('"value"'))),
        F.when((F.col("action") == "navigate") & empty("url"), F.concat(what, F.lit('"url"'))),
        F.when((F.col("action") == "wait") & F.col("timeout").isNull(), F.concat(what, F.lit('"timeout"'))),
    )
    return steps.select("workflow", "step", F.explode(F.filter(checks, lambda e: e.isNotNull())).alias("error"))


# Workflow templates and the tool table.
TEMPLATES = {
    "login": [("type", '[name="username"]', "{{username}}"), ("type", '[name="password"]', "{{password}}"), ("submit", "form", None)],
    "search": [("type", 'input[type="search"]', "{{query}}"), ("submit", "form", None)],
    "form-filling": [("type", "{{selector}}", "{{value}}"), ("submit", "form", None)],
}
TOOLS = {
    "observe": "List currently visible actionable elements.",
    "click": "Click an indexed selector or action record.",
    "type": "Type into a field.",
    "navigate": "Navigate to a URL or SPA route.",
    "extractText": "Extract text or value from a selector.",
    "waitForStable": "Wait for the DOM to become quiet.",
    "back": "Go back one history entry.",
}
# The arguments of the tools, each with its type; those of REQUIRED may not lack.
ARGUMENTS = {"click": {"selector": "string"}, "type": {"selector": "string", "value": "string"}, "navigate": {"url": "string"}, "extractText": {"selector": "string"}, "waitForStable": {"quietMs": "number", "timeout": "number"}}
REQUIRED = {"click": ("selector",), "type": ("selector", "value"), "navigate": ("url",), "extractText": ("selector",)}


def tools(spark: SparkSession) -> DataFrame:
    """``name, description, input_schema`` (JSON schema) of the tools."""

    def schema(name: str) -> str:
        out = {"type": "object", "properties": {k: {"type": t} for k, t in ARGUMENTS.get(name, {}).items()}}
        return json.dumps(out | ({"required": list(REQUIRED[name])} if name in REQUIRED else {}))

    return spark.createDataFrame([(n, d, schema(n)) for n, d in TOOLS.items()], "name string, description string, input_schema string")


def tool_errors(calls: DataFrame) -> DataFrame:
    """``id, error`` for ``calls(id, tool, arguments map)``: an unknown tool, a required argument that lacks, one that is not a number."""
    known = F.col("tool").isin(*TOOLS)
    checks = [F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit(""))))]
    for tool, types in ARGUMENTS.items():
        for name, kind in types.items():
            value = F.try_element_at(F.col("arguments"), F.lit(name))
            bad = value.isNull() & F.lit(name in REQUIRED.get(tool, ()))
            checks.append(F.when((F.col("tool") == tool) & bad, F.lit(f"{tool}: missing {name}")))
            if kind == "number":
                checks.append(F.when((F.col("tool") == tool) & value.isNotNull() & value.try_cast("double").isNull(), F.lit(f"{tool}: {name} is no number")))
    return calls.select("id", F.explode(F.filter(F.array(*checks), lambda e: e.isNotNull())).alias("error"))


def templates(spark: SparkSession) -> DataFrame:
    """``name, steps``: the workflow templates and how many steps each has."""
    return spark.createDataFrame([(n, len(t)) for n, t in TEMPLATES.items()], "name string, steps int")


def filled_template(spark: SparkSession, name: str, values: dict[str, str]) -> DataFrame:
    """Steps of a template with the known ``{{names}}`` filled in."""
    rows = [(i + 1, *s) for i, s in enumerate(TEMPLATES[name])]
    out = spark.createDataFrame(rows, "step int, action string, selector string, value string")
    for k, v in values.items():
        for c in ("selector", "value"):
            out = out.withColumn(c, F.replace(c, F.lit("{{" + k + "}}"), F.lit(v)))
    return out


def filled(contexts: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """The steps of a template for each context, with the values of some of its columns in place of their ``{{names}}``."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a).alias("action"), F.lit(s).alias("selector"), F.lit(v).cast("string").alias("value")) for i, (a, s, v) in enumerate(TEMPLATES[name], 1)])
    out = contexts.select("*", F.explode(steps).alias("_s")).select(*contexts.columns, "_s.*")
    for k in columns:
        for c in ("selector", "value"):
            out = out.withColumn(c, F.replace(c, F.lit("{{" + k + "}}"), F.col(k)))
    return out


def repeated(steps: DataFrame, times: int) -> DataFrame:
    """The steps, in order, ``times`` over."""
    n = max(0, times)
    rounds = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
    return steps.select("*", F.explode(rounds).alias("round")).orderBy("round", "step")


def composed(*parts: DataFrame) -> DataFrame:
    """Lists of steps one after another: ``part`` is the list, ``step`` its own order."""
    out = None
    for i, p in enumerate(parts):
        rows = p.withColumn("part", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.orderBy("part", "step")


def conditional(contexts: DataFrame, condition: Column, then: DataFrame, otherwise: DataFrame | None = None) -> DataFrame:
    """The steps of ``then`` for each context that meets the condition, else those of ``otherwise``, if given.

    The lists of steps are short, so they are sent to the contexts.
    """
    yes = F.coalesce(condition, F.lit(False))
    steps = then.withColumn("_yes", F.lit(True))
    if otherwise is not None:
        steps = steps.unionByName(otherwise.withColumn("_yes", F.lit(False)), allowMissingColumns=True)
    return contexts.withColumn("_yes", yes).join(F.broadcast(steps), "_yes").drop("_yes")


def exported(steps: DataFrame, by: str = "workflow") -> DataFrame:
    """``by, json``: each workflow as a JSON document ``{"version": 1, "steps": [...]}`` in order of its steps."""
    names = [c for c in steps.columns if c not in (by, "step")]
    rows = steps.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("step", F.struct(*names).alias("s")))).alias("l"))
    return rows.select(by, F.to_json(F.struct(F.lit(1).alias("version"), F.transform("l", lambda x: x["s"]).alias("steps"))).alias("json"))
