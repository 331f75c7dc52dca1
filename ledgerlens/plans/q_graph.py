"""Graph queries: link edges, typed graph, motifs, neighbour aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import features as fx
from ledgerlens.operators import graph as gr
from ledgerlens.oracle import canonical as oc
from ledgerlens.oracle import features as of
from ledgerlens.oracle import graph as og
from ledgerlens.plans.registry import query
from ledgerlens.sources import canonical as cn
from ledgerlens.sources.io import written

EV, LI = oc.TX_EVENTS, oc.TX_LINEITEM
GOLD_EV = of.gold_features(EV)
FM = fx.FEATURE_MATRIX
NODES_SQL = f"SELECT tx_id, {', '.join(FM)} FROM ({GOLD_EV}) g"


def gold_ev(spark, sf):
    return fx.gold_features(cn.tx_events(spark, sf))


@query("prior_link_edges", og.prior_links(EV))
def prior_link_edges(spark, sf):
    return gr.prior_link_edges(cn.tx_events(spark, sf))


@query("prior_link_edges_ties", og.prior_links(LI))
def prior_link_edges_ties(spark, sf):
    return gr.prior_link_edges(cn.tx_lineitem(spark, sf))


@query("shared_entity_projection", og.projection(EV))
def shared_entity_projection(spark, sf):
    return gr.shared_entity_projection(cn.tx_events(spark, sf))


@query("distinct_pairs", og.distinct_pairs(LI))
def distinct_pairs(spark, sf):
    return gr.distinct_pairs(cn.tx_lineitem(spark, sf))


@query("hetero_nodes", og.hetero_nodes(LI))
def hetero_nodes(spark, sf):
    return gr.hetero_nodes(cn.tx_lineitem(spark, sf))


@query("hetero_edges", og.hetero_edges(LI))
def hetero_edges(spark, sf):
    return gr.hetero_edges(cn.tx_lineitem(spark, sf))


@query("degree_features", og.degree(og.hetero_edges(LI)))
def degree_features(spark, sf):
    return gr.degree_features(gr.hetero_edges(cn.tx_lineitem(spark, sf)))


@query("triangle_count", og.triangles(og.projection(EV)))
def triangle_count(spark, sf):
    return gr.triangle_count(gr.shared_entity_projection(cn.tx_events(spark, sf)))


@query("motif_features", og.motif(EV))
def motif_features(spark, sf):
    tx = cn.tx_events(spark, sf)
    return gr.motif_features(tx, gr.shared_entity_projection(tx))


def _graph(spark, sf):
    """Feature nodes and prior-link edges, each written once: the encoders read them several times."""
    tx = cn.tx_events(spark, sf)
    return (written(fx.feature_matrix(fx.gold_features(tx)).drop("is_fraud"), "nodes"), written(gr.prior_link_edges(tx, places=True), "edges"))


@query("neighbor_mean", og.neighbor_mean(NODES_SQL, og.prior_links(EV), FM))
def neighbor_mean(spark, sf):
    nodes, edges = _graph(spark, sf)
    return gr.neighbor_mean(nodes, edges, FM, micro_exact=True)


_W1, _W2 = gr.sage_weights(len(FM))


@query("sage_encode", og.sage(NODES_SQL, og.prior_links(EV), FM, _W1, _W2))
def sage_encode(spark, sf):
    nodes, edges = _graph(spark, sf)
    return gr.sage_encode(nodes, edges, FM)


_rng = np.random.default_rng(11)
_WA = _rng.normal(0.0, 0.15, size=(len(FM), 8))
_AA = _rng.normal(0.0, 0.15, size=(16,))


@query("attention_mean", og.attention(NODES_SQL, og.prior_links(EV), FM, _WA, _AA))
def attention_mean(spark, sf):
    nodes, edges = _graph(spark, sf)
    return gr.attention_mean(nodes, edges, FM, out_dim=8, seed=11)


@query("prior_link_edges_skewproof", og.prior_links(LI))
def prior_link_edges_skewproof(spark, sf):
    """The edges of ``prior_link_edges_ties`` under their earlier second name."""
    return gr.prior_link_edges(cn.tx_lineitem(spark, sf))


@query("shared_entity_projection_skewproof", og.projection(EV))
def shared_entity_projection_skewproof(spark, sf):
    return gr.shared_entity_projection(cn.tx_events(spark, sf))
