"""Registered queries call their operators at the operators' defaults."""

import inspect

import pytest
from pyspark.sql import functions as F

from flowaudit.operators import attacks, explainers, models, packets, selection
from flowaudit.plans.registry import QUERIES

import __spark_entry__  # noqa: F401 - registers the queries

SIZES = {"trees", "depth", "rounds", "hidden", "iterations", "components", "samples", "candidates", "repeats", "steps", "ratio"}
CALLS = [
    ("random_forest", models, "random_forest"), ("boosted_trees", models, "boosted_trees"), ("feed_forward", models, "feed_forward"),
    ("kernel_svm", models, "kernel_svm"), ("perturbation_detector", models, "perturbation_detector"), ("protocol_lime", explainers, "protocol_lime"),
    ("quartile_lime", explainers, "quartile_lime"), ("stable_sample_count", explainers, "stable_sample_count"), ("tree_shap", models, "random_forest"),
    ("tree_interactions", models, "random_forest"), ("deep_shap", models, "feed_forward"), ("explanation_union", models, "feed_forward"),
    ("pgd_success", attacks, "adversarial_table"), ("pgd_inside_ball", attacks, "pgd"), ("explainer_robustness", explainers, "integrated_gradients"),
    ("robustness_of_explainer", explainers, "integrated_gradients"), ("model_benchmark", models, "random_forest"),
    ("iterative_pruning", models, "random_forest"),
]


class Called(Exception):
    pass


@pytest.mark.parametrize("query, module, operator", CALLS, ids=[c[0] for c in CALLS])
def test_runs_at_defaults(spark, monkeypatch, query, module, operator):
    signature = inspect.signature(getattr(module, operator))

    def caught(*args, **kw):
        raise Called(signature.bind(*args, **kw).arguments)

    monkeypatch.setattr(module, operator, caught)
    with pytest.raises(Called) as got:
        QUERIES[query](spark, "/root/testdata/sf0.001")
    given = got.value.args[0]
    assert {k: v for k, v in given.items() if k in SIZES and v != signature.parameters[k].default} == {}


def test_pruning_takes_importance_from_attributions(spark, monkeypatch):
    def caught(train, val, importance, classes, **sizes):
        raise Called((importance, sizes))

    known = [0.5, -3.0] + [1.0] * 62
    monkeypatch.setattr(models, "random_forest", lambda d: None)
    monkeypatch.setattr(models, "export", lambda m: None)
    monkeypatch.setattr(explainers, "tree_shap", lambda d, *_: d.select(F.array(*[F.lit(x) for x in known]).alias("attrs")))
    monkeypatch.setattr(selection, "iterative_pruning", caught)
    with pytest.raises(Called) as got:
        QUERIES["iterative_pruning"](spark, "/root/testdata/sf0.001")
    assert got.value.args[0] == ([abs(x) for x in known], {})


def test_packet_surrogates_take_5000_samples(spark, monkeypatch):
    monkeypatch.setattr(packets, "packet_neighbourhood", lambda rows, n, *_, **__: (_ for _ in ()).throw(Called(n)))
    with pytest.raises(Called) as got:
        QUERIES["packet_lime"](spark, "/root/testdata/sf0.001")
    assert got.value.args[0] == 5000
