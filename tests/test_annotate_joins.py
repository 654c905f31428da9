"""What grows with the sentences is never broadcast, whatever the bytes of its files: it once filled the driver's memory."""

import re

import pytest

import __spark_entry__
from tsumugi.functions.runtime import Scratch
from tsumugi.operators import annotate as A


def sent(df):
    """Broadcast joins on sentences in the plan by estimated sizes."""
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if re.search(r"Broadcast\w+Join \[[^]]*(sid|p_partkey)#", x)]


@pytest.fixture
def plans(monkeypatch):
    """The broadcast joins of all tables written meanwhile."""
    seen, write = [], Scratch.write

    def watched(self, df, name):
        seen.extend(sent(df))
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", watched)
    return seen


@pytest.fixture(scope="module")
def annotated():
    """Nodes by options, each with the broadcast joins that made them."""
    return {}


QUERIES = "q_count_syn_nodes q_child_num_min q_node_logs q_entry_containment q_wsd_filter q_full_cover_hypernym q_retrieve_sids q_antonym_attach q_hypernym_attach q_threshold_dedup q_attach_single q_format_lines q_tm_match q_attach_two_phrase q_node_counts q_hypernym_recursive".split()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name, annotated, plans, monkeypatch):
    attach, made = A.attach, []

    def once(trees, lexicon, options=None):
        if options not in annotated:
            nodes = attach(trees, lexicon, options)
            annotated[options] = nodes, list(plans)
        nodes, seen = annotated[options]
        made.extend(seen)
        return nodes

    monkeypatch.setattr(A, "attach", once)
    assert sent(__spark_entry__.queries()[name](spark, data)) + made == []
