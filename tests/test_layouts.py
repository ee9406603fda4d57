"""Views and exports of bucketed tables give the same rows without shuffling messages."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from govlens.operators import conversations as C
from govlens.operators import feedback as FB
from govlens.session import scratch_dir
from govlens.sources import fixtures as X
from govlens.sources import layouts


@pytest.fixture
def laid_out(spark, sf_dir):
    prefix = "t" + uuid.uuid4().hex
    # Messages without an order or a shuffle of their own, so that the plan shows what the view does.
    yield layouts.save_sessions(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), prefix, scratch_dir(spark, "laid_out"), 4)
    layouts.drop_tables(spark, prefix)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(df):
    return sorted(map(str, df.collect()))


def messages_below(df):
    """The plan from the gathering of messages down to their scan."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "_messages" in line)
    gather = max(i for i, line in enumerate(plan[:scan]) if "ObjectHashAggregate" in line and "functions=[collect_list" in line)
    return "\n".join(plan[gather : scan + 1])


def test_view_without_shuffles(spark, sf_dir, laid_out, no_broadcast):
    view = C.conversation_view(*laid_out)
    assert layouts.exchanges(view) == []
    assert rows(view) == rows(C.conversation_view(X.conversations(spark, sf_dir), X.messages(spark, sf_dir)))


def test_transcripts_and_exports(spark, sf_dir, laid_out, no_broadcast):
    conversations, messages = laid_out
    assert layouts.exchanges(C.session_transcript(conversations, messages)) == []
    export = C.training_export(conversations, messages, X.AS_OF)
    # The list of chosen sessions is made distinct, and dealt to the buckets; messages stay where they are.
    plain = C.training_export(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), X.AS_OF)
    assert len(layouts.exchanges(export)) <= 2 < len(layouts.exchanges(plain))
    assert "Exchange" not in messages_below(export)
    assert rows(export) == rows(C.training_export(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), X.AS_OF))


def test_long_sessions_come_in_parts(spark, sf_dir, laid_out):
    conversations, messages = laid_out
    parts = C.conversation_view(conversations, messages, part_size=3)
    assert parts.agg(F.max(F.size("messages"))).first()[0] == 3 and parts.agg(F.max("part")).first()[0] > 0
    plain = C.conversation_view(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), part_size=3)
    assert rows(parts) == rows(plain)


def test_ratings_move_once_per_session(spark, sf_dir, no_broadcast):
    prefix = "t" + uuid.uuid4().hex
    audit, feedback = layouts.save_requests(X.audit_logs(spark, sf_dir), X.feedback(spark, sf_dir), prefix, scratch_dir(spark, "requests"), 4)
    found = FB.feedback_to_session(feedback, audit)
    # One exchange, of partial results by session; audit rows and feedback stay where they are.
    assert [keys.split(",")[0] for keys in layouts.exchanges(found)] == [layouts.exchanges(found)[0].split(",")[0]]
    assert "session_id" in layouts.exchanges(found)[0]
    assert rows(found) == rows(FB.feedback_to_session(X.feedback(spark, sf_dir), X.audit_logs(spark, sf_dir)))
    layouts.drop_tables(spark, prefix)


@pytest.mark.parametrize("size, least, buckets", [(0, 1, 1), (0, 8, 8), (1 << 40, 8, 4096), ((5 << 28), 3, 8)])
def test_number_of_buckets(size, least, buckets):
    assert layouts.buckets_for(size, least) == buckets
