"""Gap filling in multi-station time series, and scoring of how well it went, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from panelfill.operators.fill import imputers, impute_grouped, register_imputer, run_methods
from panelfill.operators.boosted import impute_gbt
from panelfill.operators.centroid import impute_centroid
from panelfill.operators.chained import impute_chained
from panelfill.operators.learned import impute_als
from panelfill.operators.neighbours import impute_knn
from panelfill.operators.pattern import transfer_pattern
from panelfill.operators.rank import rank_methods
from panelfill.operators.score import evaluate

register_imputer("knn", impute_knn)
register_imputer("iterative", impute_chained)
register_imputer("xgboost", impute_gbt)
register_imputer("low_rank", impute_als)
register_imputer("centroid", impute_centroid)

__all__ = ["evaluate", "impute_als", "impute_centroid", "impute_chained", "impute_gbt", "impute_grouped", "impute_knn", "imputers",
           "rank_methods", "register_imputer", "run_methods", "transfer_pattern"]
