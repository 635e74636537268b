"""Registered model queries (rows-only checks: model fits are not SQL).

The test tables span 1995-2001: train 1995-1999, validation 2000, test 2001
mirror the published seven-year panel. Models have the published sizes, the
defaults of ModelParams and PriceParams.
"""

from __future__ import annotations

from ..operators import pricing as pr
from ..operators.graph.iterative import materialize
from ..operators.ml import governance_model as gm
from ..operators.ml import price_model as pm
from ..sources.contracts import source_signature
from .catalogue import C
from .features import features
from .registry import register

TRAIN, VAL, TEST = (1995, 1999), (2000, 2000), (2001, 2001)
FEATURES = ["contract_value_log"]   # the published locked feature set
GOV_PARAMS = gm.ModelParams()
PRICE_PARAMS = pm.PriceParams()


#: model outputs written by this process: (application, model, inputs' listing) -> tables
_STORED: dict[tuple, tuple] = {}


def _stored(spark, sf_dir, model, build):
    """The tables of ``build()``, written once per session and input listing: a model is fitted once for all its queries."""
    key = (spark.sparkContext.applicationId, model, *source_signature(spark, sf_dir))
    if key not in _STORED:
        _STORED[key] = tuple(materialize(df) for df in build())
    return _STORED[key]


def governance_model(spark, sf_dir, cols=tuple(FEATURES)):
    """The fitted members over ``cols``: their tables are stored, so that all queries share one fit."""
    parts = {}

    def build():
        parts.update(gm.fit_governance(features(spark, sf_dir), list(cols), TRAIN, VAL, TEST, GOV_PARAMS))
        return ()

    key = (spark.sparkContext.applicationId, "members", cols, *source_signature(spark, sf_dir))
    if key not in _STORED:
        build()
        _STORED[key] = (parts,)
    return _STORED[key][0]


def governance_scored(spark, sf_dir):
    return _stored(spark, sf_dir, "governance", lambda: gm.score_governance(governance_model(spark, sf_dir)))


def price_residuals(spark, sf_dir):
    """Rows with the market model's honest residuals: all that m11 and v26 need."""
    def build():
        return (pm.market_residuals(*pm.fit_market(pm.price_rows(pr.price_proxy(C(spark, sf_dir)), PRICE_PARAMS), PRICE_PARAMS), PRICE_PARAMS.folds),)
    return _stored(spark, sf_dir, "residuals", build)[0]


def price_flags(spark, sf_dir):
    def scores():
        return (pm.detector_scores(pm.detector_rows(price_residuals(spark, sf_dir)), PRICE_PARAMS),)
    return _stored(spark, sf_dir, "price", lambda: pm.consensus(_stored(spark, sf_dir, "detectors", scores)[0], PRICE_PARAMS))


@register("m05_governance_scores")
def m05_governance_scores(spark, sf_dir):
    """RF + GBT + LR ensemble, out-of-fold (train years) and held-out (test year) scores, risk class."""
    return governance_scored(spark, sf_dir)[0].drop("fold")


@register("m05_governance_metrics")
def m05_governance_metrics(spark, sf_dir):
    """Test ROC-AUC/PR-AUC per model, validation-frozen threshold metrics."""
    return gm.headline_metrics(*governance_scored(spark, sf_dir))


@register("m05_cross_validation")
def m05_cross_validation(spark, sf_dir):
    """Shuffled and forward-chaining AUC of every member: folds, mean, sd, interval."""
    forward = gm.forward_auc(features(spark, sf_dir), FEATURES, (TRAIN[0], VAL[1]), GOV_PARAMS)
    return gm.validation_table(gm.shuffled_auc(governance_scored(spark, sf_dir)[0]), forward)


@register("b11_forward_chaining_auc")
def b11_forward_chaining_auc(spark, sf_dir):
    """AUC of every member on each year after fitting on all years before it."""
    return gm.forward_auc(features(spark, sf_dir), FEATURES, (TRAIN[0], VAL[1]), GOV_PARAMS)


#: attributions and importances need two features at least
WIDER = ("contract_value_log", "buyer_concentration_hhi")


@register("m08_feature_importances")
def m08_feature_importances(spark, sf_dir):
    """The three features with the largest share of the split gain, per tree member."""
    return gm.feature_importances(governance_model(spark, sf_dir, WIDER), 3)


@register("m09_path_attributions")
def m09_path_attributions(spark, sf_dir):
    """Exact path attribution of every feature for every test row of the boosted member."""
    return gm.contributions(governance_model(spark, sf_dir, WIDER))


@register("m09_attribution_ranking")
def m09_attribution_ranking(spark, sf_dir):
    """Features by mean absolute contribution over the test rows."""
    return gm.attribution_ranking(gm.contributions(governance_model(spark, sf_dir, WIDER)))


@register("m11_price_quality")
def m11_price_quality(spark, sf_dir):
    """Held-out R², RMSE and its reduction against category medians, five-fold R² interval of the fitted model."""
    return pm.market_quality(price_residuals(spark, sf_dir))


@register("m18_price_anomalies")
def m18_price_anomalies(spark, sf_dir):
    """GBT market model, honest residuals, LOF/IF/robust-covariance flags, 2-of-3 consensus."""
    return price_flags(spark, sf_dir)[0]


@register("m17_price_metrics")
def m17_price_metrics(spark, sf_dir):
    """Calibrated contamination, consensus rate and count, LOF∩GB overlap."""
    return price_flags(spark, sf_dir)[1]


@register("m09_permutation_importance")
def m09_permutation_importance(spark, sf_dir):
    """Permutation importance (AUC drop) of two governance features for the GBT member, on the test year.

    The stored ensemble has the one locked feature, so the member is fitted on both features here, at its published size."""
    cols = ["contract_value_log", "buyer_concentration_hhi"]
    d = gm._prepare(features(spark, sf_dir), cols)
    train = gm._with_weights(d.where(d.award_year.between(*TRAIN)))
    model = gm.gbt_member(cols, GOV_PARAMS).fit(train)
    test = d.where(d.award_year.between(*TEST)).withColumn("weight", gm.F.lit(1.0))
    return gm.permutation_importance(model, test, cols)
