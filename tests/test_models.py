"""The graph of models and builds of chosen ones."""

from __future__ import annotations

import re
import uuid

import pytest
from conftest import AS_OF

from terraced import schemas
from terraced.plans import build, models
from terraced.session import scratch_path
from terraced.sources import catalog, landing
from terraced.sources.catalog import Warehouse
from terraced.sources.star_schema import read_operational

FOLDER = "/root/testdata/sf0.001"


def landed(spark, lean=False):
    wh = Warehouse(spark, f"m{uuid.uuid4().hex[:8]}_", scratch_path(spark, "models"), lean)
    landing.mirror_all(wh, landing.land(wh, landing.export_frames(read_operational(spark, FOLDER), "all"), AS_OF), "all")
    return wh


def stored(wh):
    return {
        (product, layer, table)
        for product in schemas.PRODUCTS
        for layer in schemas.LAYERS
        if catalog.namespace_exists(wh.spark, wh.namespace(product, layer))
        for table in catalog.table_names(wh.spark, wh.namespace(product, layer))
    }


def test_selectors():
    assert models.selected(["taxes_clean"]) == {"sdp_taxes.taxes_clean"}
    assert models.selected(["customers_3nf"]) == {"edp_customers.customers_3nf", "edp_orders.customers_3nf"}
    up = models.selected(["+edp_taxes.taxes_only"])
    assert up == {"sdp_taxes.taxes_clean", "sdp_taxes.taxes_grain", "edp_taxes.in_taxes_grain", "edp_taxes.taxes_3nf", "edp_taxes.taxes_only"}
    assert models.selected(["taxes_clean+"]) == up == models.selected(["+taxes_3nf+"])
    assert models.selected(["1+edp_taxes.taxes_only", "taxes_clean+1"]) == up - {"edp_taxes.in_taxes_grain"}
    assert models.selected(["+edp_taxes.taxes_only"], exclude=["package:sdp_taxes"]) == {n for n in up if n.startswith("edp")}
    assert models.without_producers(up, "edp_taxes") == {n for n in up if n.startswith("edp")}
    assert models.selected([], ["taxes_clean"]) == set()
    assert all(models.MODELS[n].layer == "access" for n in models.selected(["layer:access"]))
    for wrong in ("", "+", "tag:x", "a+b"):
        with pytest.raises(ValueError):
            models.selected([wrong])
    with pytest.raises(LookupError):
        models.selected(["taxes_cleam"])


def test_levels_follow_needs():
    steps = models.levels(models.MODELS)
    at = {name: number for number, step in enumerate(steps) for name in step}
    assert len(at) == len(models.MODELS)
    assert all(at[parent] < at[m.name] for m in models.MODELS.values() for parent in m.parents if parent in at)
    assert all(parent in at or parent in models.SOURCES for m in models.MODELS.values() for parent in m.parents)
    assert models.levels([]) == []


def test_all_models_are_the_full_build(spark):
    ours, full = landed(spark), landed(spark)
    for scope in schemas.SCOPES:
        build.build_source(full, scope, AS_OF)
        build.build_domain(full, scope, AS_OF)
    written = models.build_selected(ours, models.MODELS, models.Settings(AS_OF))
    assert sorted(written) == sorted(models.MODELS)
    assert stored(ours) == stored(full)
    for name in ("edp_orders.orders_fulfilled", "edp_customers.customers_complete", "edp_taxes.taxes_only"):
        product, table = name.split(".")
        mine, theirs = ours.table(product, "access", table), full.table(product, "access", table)
        assert mine.exceptAll(theirs).count() == 0 and mine.count() == theirs.count() > 0


def test_only_what_was_chosen_is_written(spark):
    wh = landed(spark, lean=True)
    before = stored(wh)
    names = models.selected(["+edp_taxes.taxes_only"])
    with pytest.raises(LookupError, match="sdp_taxes.taxes_grain"):
        models.build_selected(wh, models.without_producers(names, "edp_taxes"), models.Settings(AS_OF))
    assert stored(wh) == before
    models.build_selected(wh, names, models.Settings(AS_OF))
    assert {f"{p}.{t}" for p, _, t in stored(wh) - before} == names
    only = wh.table("edp_taxes", "access", "taxes_only")
    assert only.count() == wh.source("sdp_taxes", "ext_taxes_raw").count()
    assert all(re.search(r"sdp_taxes__core\.db/taxes_clean", f) for f in only.inputFiles())  # lean: views down to the one table
