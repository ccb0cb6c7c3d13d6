"""The registered queries ask for the operators' whole default work."""

import pytest

from tablemine.plans import models, patterns, registry

#: What says which operator a query shows, not how much it does.
KINDS = {"kernel", "loss", "preprocessor", "k"}
LEARNERS = {
    "random_forest": "RandomForest", "svm_linear": "Svm", "svm_rbf": "Svm", "svm_poly": "Svm", "neural_network": "NeuralNetwork",
    "adaboost": "AdaBoost", "sgd_classifier": "Sgd", "random_forest_regression": "RandomForest", "adaboost_regression": "AdaBoost",
    "sgd_regressor": "Sgd",
}


class Asked(Exception):
    pass


def asked(*args, **settings):
    raise Asked(settings)


@pytest.mark.parametrize("name", [*LEARNERS, "kmeans_annotated", "kmeans_centroids"])
def test_defaults(spark, sf, monkeypatch, name):
    monkeypatch.setattr(*((models, LEARNERS[name]) if name in LEARNERS else (patterns, "kmeans")), asked)
    with pytest.raises(Asked) as found:
        registry.QUERIES[name](spark, sf)
    assert set(found.value.args[0]) <= KINDS
