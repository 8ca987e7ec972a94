"""Every model of the products with what it reads, and builds of chosen models only.

A model gets the frames of its parents and nothing else, so the graph is what the
models really read. Mirrored tables are the graph's sources: read, never written here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from terraced.plans import customer_domain as cd
from terraced.plans import source_products as sp
from terraced.plans import transaction_domain as td
from terraced.plans.build import UPSTREAM, Bands
from terraced.schemas import LANDED, SCOPES
from terraced.sources.catalog import Warehouse

TABLE, SELECTION, VIEW = "table", "selection", "view"

_SELECTOR = re.compile(r"(?P<up>(?P<up_depth>\d*)\+)?(?P<what>[^+]+)(?P<down>\+(?P<down_depth>\d*))?")


@dataclass(frozen=True)
class Settings:
    as_of: datetime
    bands: Bands = Bands()


@dataclass(frozen=True)
class Model:
    """A relation: its layer, its parents, how it comes from their frames, and how it is kept.

    A ``SELECTION`` of its first parent's columns is a view in a lean warehouse; a
    ``VIEW`` republishes its parent everywhere.
    """

    name: str
    layer: str
    parents: tuple[str, ...]
    make: Callable[..., DataFrame]
    kind: str = TABLE

    @property
    def product(self) -> str:
        return self.name.partition(".")[0]

    @property
    def table(self) -> str:
        return self.name.partition(".")[2]


# Where the mirrored tables are, by name.
SOURCES = {f"sdp_{owner}.{mirror}": ("inbound", mirror) for mirror, owner, _, _ in LANDED.values()}


def _declared() -> dict[str, Model]:
    models: dict[str, Model] = {}

    def add(product: str, layer: str, table: str, parents: str, make: Callable[..., DataFrame], kind: str = TABLE) -> None:
        full = tuple(p if "." in p else f"{product}.{p}" for p in parents.split())
        models[f"{product}.{table}"] = Model(f"{product}.{table}", layer, full, make, kind)

    def published(product: str, grain: str, core: str) -> None:
        add(product, "access", grain, core, lambda s, df: sp.publish(df, grain), SELECTION)

    orders, customers, taxes, depot = "sdp_orders", "sdp_customers", "sdp_taxes", "sdp_depot_transactions"
    add(orders, "core", "orders_clean", "ext_orders_raw", lambda s, raw: sp.orders_clean(raw, s.as_of, s.bands.orders))
    add(orders, "core", "order_items_clean", "ext_order_items_raw", lambda s, raw: sp.order_items_clean(raw, s.as_of))
    add(orders, "core", "customer_order_summary", "orders_clean", lambda s, df: sp.customer_order_summary(df))
    published(orders, "orders_order_grain", "orders_clean")
    published(orders, "orders_customer_grain", "customer_order_summary")
    published(orders, "order_lines_order_grain", "order_items_clean")
    add(customers, "core", "customers_clean", "ext_customers_raw", lambda s, raw: sp.customers_clean(raw, s.as_of, s.bands.customers))
    published(customers, "customers_entity_grain", "customers_clean")
    for by in ("region", "segment"):
        add(customers, "core", f"customer_{by}_summary", "customers_clean", lambda s, df, by=by: sp.customer_summary(df, by))
        add(customers, "access", f"customers_{by}_grain", f"customer_{by}_summary", lambda s, df: df, SELECTION)
    add(taxes, "core", "taxes_clean", "ext_taxes_raw", lambda s, raw: sp.taxes_clean(raw, s.as_of, s.bands.rates))
    published(taxes, "taxes_grain", "taxes_clean")
    clean = "depot_transactions_clean"
    add(depot, "core", clean, "ext_depot_transactions_raw", lambda s, raw: sp.depot_transactions_clean(raw, s.as_of, s.bands.amounts))
    published(depot, "depot_transactions_grain", clean)

    for scope in SCOPES:
        for grain in UPSTREAM[scope]:
            add(f"edp_{scope}", "inbound", f"in_{grain}", f"sdp_{scope}.{grain}", lambda s, df: df, VIEW)

    def plain(product: str, layer: str, table: str, parent: str, model: Callable[[DataFrame], DataFrame], kind: str = SELECTION) -> None:
        add(product, layer, table, parent, lambda s, df: model(df), kind)

    edp = "edp_customers"
    plain(edp, "core", "customers_3nf", "in_customers_entity_grain", cd.customers_3nf)
    plain(edp, "core", "regions_3nf", "in_customers_region_grain", cd.regions_3nf)
    plain(edp, "core", "segments_3nf", "in_customers_segment_grain", cd.segments_3nf)
    plain(edp, "core", "dim_regions", "regions_3nf", cd.dim_regions, TABLE)
    plain(edp, "core", "dim_segments", "segments_3nf", cd.dim_segments, TABLE)
    star = "fct_customer_value_star"
    add(edp, "core", star, "customers_3nf dim_regions dim_segments", lambda s, *read: cd.fct_customer_value_star(*read, s.as_of))
    plain(edp, "access", "customers_complete", star, cd.customers_complete)
    plain(edp, "access", "customers_only", star, cd.customers_only)
    plain(edp, "access", "customers_high_value", star, cd.customers_high_value, TABLE)
    plain("edp_taxes", "core", "taxes_3nf", "in_taxes_grain", cd.taxes_3nf)
    plain("edp_taxes", "access", "taxes_only", "taxes_3nf", cd.taxes_only)

    edp = "edp_orders"
    plain(edp, "core", "orders_3nf", "in_orders_order_grain", td.orders_3nf)
    plain(edp, "core", "order_lines_3nf", "in_order_lines_order_grain", td.order_lines_3nf)
    plain(edp, "core", "customers_3nf", "in_orders_customer_grain", td.customers_3nf)
    plain(edp, "core", "dim_customers", "customers_3nf", td.dim_customers, TABLE)
    plain(edp, "core", "dim_order_status", "orders_3nf", td.dim_order_status, TABLE)
    star = "fct_order_revenue_star"
    add(
        edp, "core", star, "orders_3nf order_lines_3nf dim_customers dim_order_status",
        lambda s, placed, lines, by, status: td.fct_order_revenue_star(placed, td.items_per_order(lines), by, status, s.as_of),
    )
    plain(edp, "access", "orders_complete", star, td.orders_complete)
    plain(edp, "access", "orders_only", star, td.orders_only)
    plain(edp, "access", "orders_fulfilled", star, td.orders_fulfilled, TABLE)
    plain("edp_depot_transactions", "core", "depot_transactions_3nf", "in_depot_transactions_grain", td.depot_transactions_3nf)
    plain("edp_depot_transactions", "access", "depot_transactions_only", "depot_transactions_3nf", td.depot_transactions_only)
    return models


MODELS = _declared()


def reach(names: Iterable[str], edges: Mapping[str, Iterable[str]], depth: int | None = None) -> set[str]:
    """``names`` and what they lead to within ``depth`` steps, or at all."""
    seen = set(names)
    front, step = set(seen), 0
    while front and (depth is None or step < depth):
        front = {n for name in front for n in edges.get(name, ())} - seen
        seen |= front
        step += 1
    return seen


def selected(select: Iterable[str], exclude: Iterable[str] = ()) -> set[str]:
    """Models that any of ``select`` names and none of ``exclude``.

    A selector names models by ``product.table``, by ``table``, by ``package:<product>`` or by
    ``layer:<layer>``; ``+`` before it adds all that it needs, ``+`` after it all that needs it, a
    number at the ``+`` only so many steps. One that names nothing raises.
    """
    left_out = {name for selector in exclude for name in _named(selector)}
    return {name for selector in select for name in _named(selector)} - left_out


def _named(selector: str) -> set[str]:
    parts = _SELECTOR.fullmatch(selector.strip())
    if not parts:
        raise ValueError(f"no selector: {selector!r}")
    kind, _, value = parts["what"].rpartition(":")
    if kind not in ("", "package", "layer"):
        raise ValueError(f"no selector: {selector!r}")
    fits = {
        "": lambda m: value in (m.name, m.table),
        "package": lambda m: m.product == value,
        "layer": lambda m: m.layer == value,
    }[kind]
    found = {m.name for m in MODELS.values() if fits(m)}
    if not found:
        raise LookupError(f"{selector!r} selects no model")
    names = set(found)
    if parts["up"]:
        up = {m.name: [p for p in m.parents if p in MODELS] for m in MODELS.values()}
        names |= reach(found, up, int(parts["up_depth"]) if parts["up_depth"] else None)
    if parts["down"]:
        down: dict[str, list[str]] = {}
        for m in MODELS.values():
            for parent in m.parents:
                down.setdefault(parent, []).append(m.name)
        names |= reach(found, down, int(parts["down_depth"]) if parts["down_depth"] else None)
    return names


def levels(names: Iterable[str]) -> list[list[str]]:
    """The models in steps, each after all of its chosen parents."""
    left, steps = set(names), []
    while left:
        ready = sorted(n for n in left if not left.intersection(MODELS[n].parents))
        steps.append(ready)
        left -= set(ready)
    return steps


def without_producers(names: Iterable[str], product: str) -> set[str]:
    """A product's own models only: what its producers own is read, never built from here."""
    return {n for n in names if MODELS[n].product == product}


def missing_parents(wh: Warehouse, names: Iterable[str]) -> list[str]:
    """Relations that the models read, that are not among them and that are not stored."""
    chosen = set(names)
    needed = sorted({p for n in chosen for p in MODELS[n].parents} - chosen)
    return [p for p in needed if not wh.exists(*_place(p))]


def _place(name: str) -> tuple[str, str, str]:
    product, _, table = name.partition(".")
    return product, SOURCES[name][0] if name in SOURCES else MODELS[name].layer, table


def build_selected(wh: Warehouse, names: Iterable[str], settings: Settings, at_once: int = 4) -> list[str]:
    """Write the chosen models in the order of their needs and return their names as written.

    Models of one step don't read each other and are written side by side. Parents
    that were not chosen are read as stored; if any is missing nothing is written.
    """
    chosen = set(names)
    missing = missing_parents(wh, chosen)
    if missing:
        raise LookupError(f"not built and not selected: {', '.join(missing)}")
    written: list[str] = []
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for step in levels(chosen):
            run = inheritable_thread_target(wh.spark)(partial(_write, wh, settings))
            for done in [pool.submit(run, name) for name in step]:
                done.result()
            written += step
    return written


def _write(wh: Warehouse, settings: Settings, name: str) -> None:
    model = MODELS[name]
    product, layer, table = _place(name)
    over = wh.name(*_place(model.parents[0]))
    if model.kind == VIEW:
        wh.view(product, layer, table, over)
        return
    df = model.make(settings, *[wh.table(*_place(p)) for p in model.parents])
    if model.kind == SELECTION:
        wh.project(product, layer, table, df, over)
    else:
        wh.write(product, layer, table, df)
