"""Learners: settings with ``fit``, giving models with ``transform``."""

from tablemine.operators.learners.base import Learner, Model, learner_contract, train_metrics
from tablemine.operators.learners.linear import LinearRegression, LogisticRegression, Svm, coefficients
from tablemine.operators.learners.simple import Constant, Knn, NaiveBayes
from tablemine.operators.learners.trees import AdaBoost, DecisionTree, RandomForest, tree_structure
from tablemine.operators.learners.descent import NeuralNetwork, Sgd

__all__ = [
    "AdaBoost", "Constant", "DecisionTree", "Knn", "Learner", "LinearRegression", "LogisticRegression", "Model",
    "NaiveBayes", "NeuralNetwork", "RandomForest", "Sgd", "Svm", "coefficients", "learner_contract", "train_metrics",
    "tree_structure",
]
