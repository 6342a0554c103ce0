"""Vote proxies: which hot and cold wallets act as one voter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlake.functions.asof import NOW, AsOf
from ballotlake.functions.folds import PER_ROW, found_at, known_at, latest
from ballotlake.functions.settle import settle
from ballotlake.model import GovTables
from ballotlake.operators.balances import locked_balances
from ballotlake.sources.located import at_block


def parties() -> Column:
    """The wallets of a proxy row, once each."""
    return F.array_distinct(F.array("hot", "cold"))


def active_links(t: GovTables, as_of: AsOf) -> DataFrame:
    """Proxy rows, with their id, that are the latest by block for both of their wallets."""
    links = at_block(t.proxy, t.block).where(as_of.keeps()).select(
        "id", "hot", "cold", "vote_proxy", "block_id"
    )
    newest = links.select(F.explode(parties()).alias("party"), "block_id").groupBy("party").agg(
        F.max("block_id").alias("newest")
    )
    for_hot = newest.select(F.col("party").alias("hot"), F.col("newest").alias("hot_newest"))
    for_cold = newest.select(F.col("party").alias("cold"), F.col("newest").alias("cold_newest"))
    return (
        links.join(for_hot, "hot").where(F.col("block_id") >= F.col("hot_newest"))
        .join(for_cold, "cold").where(F.col("block_id") >= F.col("cold_newest"))
        .select("id", "hot", "cold", F.col("vote_proxy").alias("proxy"))
    )


def active_proxies(t: GovTables, as_of: AsOf = NOW) -> DataFrame:
    """Links that no later link of either wallet replaced, as of a block or time."""
    if as_of.many:
        from ballotlake.operators import many_cuts
        return many_cuts.active_proxies(t, as_of)
    return active_links(t, as_of).select("hot", "cold", "proxy")


def funded_links(t: GovTables) -> DataFrame:
    """Proxy rows, with their id, whose contract holds locked tokens now."""
    held = locked_balances(t).where(F.col("balance") > 0).select(
        F.col("address").alias("vote_proxy"), F.col("balance").alias("proxy_weight")
    )
    return t.proxy.join(held, "vote_proxy").select(
        "id", "hot", "cold", F.col("vote_proxy").alias("proxy"), "proxy_weight"
    )


def funded_proxies(t: GovTables) -> DataFrame:
    """Links whose contract holds locked tokens now; a wallet may be in several."""
    return funded_links(t).select("hot", "cold", "proxy", "proxy_weight")


def links_for(t: GovTables, as_of: AsOf) -> DataFrame:
    """The links that count at a point in time: active ones, or funded ones for now."""
    return funded_links(t).drop("proxy_weight") if as_of.is_now else active_links(t, as_of)


def wallet_pairs(t: GovTables) -> DataFrame:
    """``address`` and the wallet linked to it (``voter``), both ways, over active links."""
    links = active_proxies(t).where(F.col("hot") != F.col("cold"))
    both = F.array(
        F.struct(F.col("cold").alias("address"), F.col("hot").alias("voter")),
        F.struct(F.col("hot").alias("address"), F.col("cold").alias("voter")),
    )
    return links.select(F.inline(both)).distinct()


def canonical_voter(t: GovTables, addresses: DataFrame, cut=None) -> DataFrame:
    """``addresses`` (column ``address``) with ``canonical``: its newest proxy contract, or itself.

    With a cut only links up to that block id count, and a link is void when
    the other wallet has a link from a later block.  ``cut=None`` looks at all
    links and does not check the other wallet.  ``cut=PER_ROW`` reads the cut
    of each row from ``cut_id``.
    """
    place = ["address", "cut_id"] if cut is PER_ROW else ["address"]
    link = F.struct("block_id", "hot", "cold", "vote_proxy").alias("link")
    history = t.proxy.select(F.explode(parties()).alias("address"), "id", "block_id", link)
    newest = [latest("link", "link", "id")]

    shared = cut is not PER_ROW
    # With one cut for all, every wallet's newest link comes from one small aggregate, used for both wallets of a link,
    # and ``addresses`` takes part once.
    own = known_at(addresses, history, "address", newest, cut, all_asked=shared)
    if not shared:
        own = settle(own, "links")
    if cut is not None:
        other = F.when(F.col("address") == F.col("link.cold"), F.col("link.hot")).otherwise(
            F.col("link.cold")
        )
        asked = own.select(
            F.col("address").alias("asker"), *place[1:], F.col("link").alias("own"),
            other.alias("address"),
        )
        own = (
            found_at(asked, history, "address", newest, cut, all_asked=shared)
            .where(F.col("link.block_id") <= F.col("own.block_id"))
            .select(F.col("asker").alias("address"), *place[1:], F.col("own").alias("link"))
        )
    known = own.select(*place, F.col("link.vote_proxy").alias("_contract"))
    return (
        addresses.join(known, place, "left")
        .withColumn("canonical", F.coalesce("_contract", "address")).drop("_contract")
    )
