"""Calls of a model or an embedder, and what is logged about them.

The caller passes a factory; it runs once per partition on the executors and
returns the function to call. Answers are data: write the output of a call
(``session.stage``) before it is read twice, or the model is called twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from textgraph.functions import fixed
from textgraph.functions.joins import row_join
from textgraph.session import spread

Model = Callable[[str, str], str]
Embedder = Callable[[list[str]], list[list[float]]]

CHOICE = "reasoning string, selected_class string, selected_number int"
LABEL_LISTS = "onderwerp_labels array<string>, beleving_labels array<string>"


def _tools():
    """Pace and errors of calls, as functions that travel by value."""

    def pace(rate: float | None, tasks: int, wait: float):
        """When a task may call: makes a function that waits for its turn, and one that hears how a call went.

        Calls of all tasks stand on one grid of 1/rate seconds of the clock; every ``tasks``-th place of it belongs to
        a task, so the tasks together keep the rate without talking to each other. A rate limit doubles the places
        that a task lets pass, each answer brings them back by a tenth. Without a rate the same is done with pauses.
        """
        import threading
        import time

        lock = threading.Lock()
        state = {"last": 0.0, "slower": 1.0}

        def turn(task: int) -> None:
            with lock:
                now = time.time()
                if rate:
                    own = tasks / rate  # seconds between the places of a task
                    first = task / rate
                    earliest = max(now, state["last"] + own * round(state["slower"]) - own / 2)
                    at = first + own * -(-(earliest - first) // own)
                else:
                    at = max(now, state["last"] + (state["slower"] - 1.0) * wait / 10)
                state["last"] = at
            time.sleep(max(0.0, at - time.time()))

        def told(limited: bool) -> None:
            with lock:
                state["slower"] = min(state["slower"] * 2, 64.0) if limited else max(1.0, state["slower"] * 0.9)

        return turn, told

    def is_limit(error: Exception) -> bool:
        told = str(error)
        return "429" in told or "rate limit" in told.lower()

    return pace, is_limit


def _caller(make_model: Callable[[], Model], tries: int, wait: float, threads: int, rate: float | None, tasks: int, ready: int):
    """The batch function, over a sliding window of open calls; finished rows leave as they come.

    It carries no name of this package, so executors need nothing but the factory.
    """
    pace, is_limit = _tools()

    def run(batches):
        import time
        from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor
        from concurrent.futures import wait as some_done
        from datetime import datetime, timezone

        import pandas as pd
        from pyspark import TaskContext

        model, task = make_model(), TaskContext.get().partitionId()
        turn, told = pace(rate, tasks, wait)

        def once(row):
            for attempt in range(1, tries + 1):
                turn(task)
                asked_at = datetime.now(timezone.utc)
                try:
                    answer = model(row["system_prompt"], row["human_prompt"])
                    told(False)
                    return {**row, "response": answer, "error": None if answer else "no response", "attempts": attempt, "asked_at": asked_at}
                except Exception as error:  # the row keeps it
                    refused, limited = "RefusalError" in type(error).__name__, is_limit(error)
                    told(limited)
                    if attempt == tries or not (refused or limited):
                        error = f"{type(error).__name__}: {error}"
                        return {**row, "response": None, "error": error, "attempts": attempt, "asked_at": asked_at}
                    time.sleep(wait if refused else wait * 2 ** (attempt - 1))

        def rows():
            for batch in batches:
                names = list(batch.columns)
                for values in zip(*(batch[n] for n in names)):
                    yield dict(zip(names, values))

        def frame(done):
            out = pd.DataFrame(done)
            out["asked_at"] = pd.to_datetime(out["asked_at"], utc=True)
            return out

        done, open_ = [], set()
        with ThreadPoolExecutor(threads) as pool:
            for row in rows():
                if row["response"] is not None:  # stored
                    done.append({**row, "error": None if row["response"] else "no response", "attempts": 0, "asked_at": None})
                else:
                    open_.add(pool.submit(once, row))
                if len(open_) >= 2 * threads:  # one waits for each that runs
                    ended, open_ = some_done(open_, return_when=FIRST_COMPLETED)
                    done += [f.result() for f in ended]
                if len(done) >= ready:
                    yield frame(done)
                    done = []
            while open_:
                ended, open_ = some_done(open_, return_when=FIRST_COMPLETED)
                done += [f.result() for f in ended]
                if len(done) >= ready:
                    yield frame(done)
                    done = []
        if done:
            yield frame(done)

    return run


def model_map(
    prompts: DataFrame,
    make_model: Callable[[], Model],
    tries: int = 1,
    wait: float = 1.0,
    threads: int = 1,
    partitions: int | None = None,
    by: list[str] = ("human_prompt",),
    rate: float | None = None,
    ready: int = 200,
) -> DataFrame:
    """Call a model once per row of system_prompt and human_prompt.

    Adds response, error, attempts and the time of the last call; a row that comes with a response keeps
    it and is not asked. With ``tries`` above 1 a refusal waits one unit, a rate
    limit one unit and then twice that; any other error ends the tries at once.
    ``threads`` calls run at a time in a task, a slow one holds up no other, and
    rows leave the task by ``ready``, as they are answered. ``rate`` bounds the
    calls per second of all tasks together (by the clocks of their machines); a
    task that meets a rate limit slows down and recovers. ``partitions`` sets the number of
    tasks over which rows are spread by the columns ``by`` (None: the cores of
    the cluster, 0: the rows stay where they are).
    """
    if "response" not in prompts.columns:
        prompts = prompts.withColumn("response", F.lit(None).cast("string"))
    if partitions is None:
        partitions = prompts.sparkSession.sparkContext.defaultParallelism
    prompts = spread(prompts, partitions, *by)
    schema = T.StructType([
        *prompts.schema.fields, T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType()),
        T.StructField("asked_at", T.TimestampType()),
    ])
    tasks = (partitions or prompts.rdd.getNumPartitions()) if rate else 1
    return prompts.mapInPandas(_caller(make_model, tries, wait, threads, rate, tasks, ready), schema)


def answered(
    prompts: DataFrame,
    stored: DataFrame | None,
    make_model: Callable[[], Model] | None = None,
    **options,
) -> DataFrame:
    """Answers of a call: stored ones first, the model for the rest.

    ``prompts`` has source_id, call_name and both prompts; ``stored`` is
    (source_id, call_name, assistant_response) and, in a log, created_at; of
    several rows of a key the latest counts. The prompts are made and joined once.
    """
    if stored is None and make_model is None:
        raise ValueError("either stored answers or a model is needed")
    keys = ["source_id", "call_name"]
    if stored is not None:
        latest = F.max_by("assistant_response", "created_at") if "created_at" in stored.columns else F.max("assistant_response")
        known = stored.groupBy(*keys).agg(latest.alias("response"))
        prompts = row_join(prompts, known, keys, "left")
    if make_model is not None:
        return model_map(prompts, make_model, by=keys, **options)
    return prompts.withColumns({
        "error": F.when(F.coalesce("response", F.lit("")) == "", "no response"), "attempts": F.lit(0),
        "asked_at": F.lit(None).cast("timestamp"),
    })


def structured(answers: DataFrame, schema: str, valid: Column, response: str = "response") -> DataFrame:
    """Parse typed answers; a bad one has a NULL ``answer`` and a reject_reason.

    ``valid`` is a predicate over ``parsed``.
    """
    read = answers.withColumn("parsed", F.from_json(response, schema))
    ok = F.coalesce(valid, F.lit(False))
    return (
        read.withColumn("answer", F.when(ok, F.col("parsed")))
        .withColumn("reject_reason", F.when(F.col(response).isNull(), "no response").when(~ok, "answer does not fit its type"))
        .drop("parsed")
    )


def structured_choice(answers: DataFrame) -> DataFrame:
    """A class choice: reasoning, a name and a number from 1 to 5."""
    p = F.col("parsed")
    valid = (
        p["reasoning"].isNotNull() & p["selected_class"].isNotNull()
        & p["selected_number"].between(1, fixed.TOP_K)
    )
    return structured(answers, CHOICE, valid)


def structured_labels(answers: DataFrame) -> DataFrame:
    """Two label lists with at least one label each."""
    p = F.col("parsed")
    return structured(answers, LABEL_LISTS, (F.size(p["onderwerp_labels"]) > 0) & (F.size(p["beleving_labels"]) > 0))


def proposed_rows(labelled: DataFrame) -> DataFrame:
    """Proposed labels as rows: doc_id, signal_type, pos, label."""
    lists = F.create_map(
        F.lit(fixed.ONDERWERP), F.col("answer.onderwerp_labels"), F.lit(fixed.BELEVING), F.col("answer.beleving_labels")
    )
    return (
        labelled.filter("answer IS NOT NULL").select("doc_id", F.explode(lists).alias("signal_type", "names"))
        .select("doc_id", "signal_type", F.posexplode("names").alias("pos", "label"))
        .withColumn("pos", F.col("pos").cast("long"))
    )


def choice_or_first(topk: DataFrame, choices: DataFrame, keys: list[str]) -> DataFrame:
    """The chosen class, or the first candidate where no choice was made or its
    number lies behind the last candidate.

    A text without candidates gets no class and is dropped.
    """
    chosen = choices.select(
        *keys, F.col("answer.selected_class").alias("_name"), F.col("answer.selected_number").alias("_number")
    )
    first = F.get("candidates", F.lit(0))["class_label"]
    return (
        row_join(topk, chosen, keys, "left")
        .withColumn("chosen", F.when(F.col("_number") <= F.size("candidates"), F.col("_name")))
        .withColumn("schema_label", F.coalesce("chosen", first))
        .withColumn("fell_back", F.col("chosen").isNull())
        .filter("schema_label IS NOT NULL").drop("chosen", "_name", "_number")
    )


def embed_map(
    texts: DataFrame,
    make_embedder: Callable[[], Embedder],
    column: str = "embed_text",
    tries: int = fixed.MAX_TRIES,
    wait: float = 1.0,
    batch_bytes: int = 1 << 18,
    rate: float | None = None,
) -> DataFrame:
    """A vector for each distinct text, or NULL and the error.

    A call takes texts up to ``batch_bytes`` together (a longer text goes alone).
    A batch that fails is halved and asked again, so one bad text among n costs
    its own vector and about 2 log2 n calls. A rate limit is waited for as in
    ``model_map`` and halves what goes into a call, the batch that met it too; each call that succeeds adds
    an eighth again, up to ``batch_bytes``. What stays limited after all tries, each with half as much, is given
    up together, not asked text by text. ``rate`` bounds the calls per second of all tasks.
    """
    distinct = texts.select(column).distinct()
    tasks = distinct.rdd.getNumPartitions() if rate else 1
    pace, is_limit = _tools()

    def run(batches):
        import time

        import pandas as pd
        from pyspark import TaskContext

        embed, task = make_embedder(), TaskContext.get().partitionId()
        turn, told = pace(rate, tasks, wait)
        room = batch_bytes

        def asked(some):
            """Vectors, or the error and whether it was a limit."""
            nonlocal room
            turn(task)
            try:
                vectors = embed(some)
                told(False)
                room = min(batch_bytes, room + batch_bytes // 8)
                return vectors, None, False
            except Exception as error:  # the row keeps it
                limited = is_limit(error)
                told(limited)
                if limited:
                    room = max(1, room // 2)
                return None, f"{type(error).__name__}: {error}", limited

        def halved(some):
            """(text, vector, error) of each; halves of a failed batch are asked until the bad texts stand alone."""
            todo = [(some, 1)]
            while todo:
                part, attempt = todo.pop()
                vectors, error, limited = asked(part)
                if error is None:
                    yield from ((t, v, None) for t, v in zip(part, vectors))
                elif limited and attempt == tries or not limited and len(part) == 1:
                    yield from ((t, None, error) for t in part)
                else:
                    if limited:
                        time.sleep(wait * 2 ** (attempt - 1))
                        attempt += 1
                    middle = -(-len(part) // 2)
                    todo += [(p, attempt) for p in (part[middle:], part[:middle]) if p]

        def frame(some):
            return pd.DataFrame(list(halved(some)), columns=[column, "embedding", "error"])

        held, size = [], 0
        for batch in batches:
            for text in batch[column]:
                n = len((text or "").encode())
                if held and size + n > room:
                    yield frame(held)
                    held, size = [], 0
                held.append(text)
                size += n
        if held:
            yield frame(held)

    return distinct.mapInPandas(run, f"{column} string, embedding array<float>, error string")


def call_log_rows(calls: DataFrame, worker_id: Column, model_name: Column) -> DataFrame:
    """Log rows of calls that were answered and have a source; the time is that of the call, if it was kept."""
    asked_at = F.col("asked_at") if "asked_at" in calls.columns else F.lit(None).cast("timestamp")
    return calls.filter("source_id IS NOT NULL AND response IS NOT NULL").select(
        F.col("source_id").cast("long").alias("source_id"),
        "call_name", "system_prompt", "human_prompt",
        F.col("response").alias("assistant_response"),
        F.coalesce(asked_at, F.current_timestamp()).alias("created_at"),
        worker_id.alias("worker_id"),
        model_name.alias("model_name"),
    )
