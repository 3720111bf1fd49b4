"""The registered fits run to the end."""

import pytest

from strandloom.operators import metrics
from strandloom.operators.topics import corex, guided
from strandloom.plans import decon_queries, topic_queries

FOLDER = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


@pytest.mark.parametrize("module, name, query, least", [
    (guided, "fit_guided", topic_queries.guided_lda, 100), (guided, "fit_guided", topic_queries.guided_lda_infer, 100),
    (corex, "fit_corex", topic_queries.corex_topics, 100), (corex, "fit_corex", topic_queries.corex_hierarchy, 100),
    (metrics, "bootstrap", decon_queries.bootstrap_ci, 1000),
])
def test_queries_ask_for_whole_fits(spark, monkeypatch, module, name, query, least):
    import inspect

    sign = inspect.signature(getattr(module, name))

    def asked(*args, **kwargs):
        b = sign.bind(*args, **kwargs)
        b.apply_defaults()
        raise Asked(b.arguments["rounds" if name == "bootstrap" else "n_iter"])

    monkeypatch.setattr(module, name, asked)
    with pytest.raises(Asked) as e:
        query(spark, FOLDER)
    assert e.value.args[0] >= least
