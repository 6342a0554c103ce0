"""Voting weight: over all addresses (set form) and of given voters (row form)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlake.functions.asof import EVERY, NOW, AsOf, one_column, only
from ballotlake.functions.folds import PER_ROW, known_at, latest
from ballotlake.functions.settle import settle
from ballotlake.model import AMOUNT, RESULT, GovTables
from ballotlake.operators.balances import ledger, or_zero, own_balances, wallet_of
from ballotlake.operators.proxies import links_for, parties


# --- set form -------------------------------------------------------------------------------


def weigh_links(links: DataFrame, accounts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Wallet and locked balance of hot and of cold, and the locked balance of the contract.

    A wallet that is both hot and cold counts twice.  The members of each link
    are listed as rows, so one join with the ledger serves all five terms.
    ``by`` names further columns that links and accounts must agree in.
    """
    members = F.inline(F.array(*[
        F.struct(F.col(member).alias("address"), F.lit(wallet).alias("with_wallet"))
        for member, wallet in (("hot", True), ("cold", True), ("proxy", False))
    ]))
    held = or_zero(F.when(F.col("with_wallet"), wallet_of()))
    return (
        links.select("id", "hot", "cold", "proxy", *by, members)
        .join(accounts, ["address", *by], "left")
        .withColumn("part", (held + or_zero(F.col("locked"))).cast(AMOUNT))
        .groupBy("id", "hot", "cold", "proxy", *by)
        .agg(F.sum("part").alias("total_weight"))
    )


def proxy_weights(t: GovTables, as_of: AsOf = NOW) -> DataFrame:
    """Weight behind every proxy that counts at a point in time."""
    if as_of.many:
        from ballotlake.operators import many_cuts
        return many_cuts.proxy_weights(t, as_of)
    weights = weigh_links(links_for(t, as_of), ledger(t, as_of))
    return weights.select("hot", "cold", "proxy", F.col("total_weight").cast(RESULT).alias("total_weight"))


def party_rows(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return weights.select(
        F.explode(F.array("hot", "cold")).alias("address"),
        F.col("total_weight").cast(RESULT).alias("total_weight"), *by,
    ).distinct()


def party_weights(t: GovTables, as_of: AsOf = NOW) -> DataFrame:
    """Proxy weight listed under the hot and under the cold wallet, equal rows once."""
    if as_of.many:
        from ballotlake.operators import many_cuts
        return many_cuts.party_weights(t, as_of)
    return party_rows(weigh_links(links_for(t, as_of), ledger(t, as_of)))


def voting_weights(t: GovTables, as_of: AsOf = NOW, addresses=EVERY) -> DataFrame:
    """Weight of every address: its proxies' weights, or else its own balance.

    Every proxy row wins over the balance of its address, so the result is the
    proxy rows plus the balances of all other addresses.  Locked-only rows
    (NULL address) match nothing; they are joined under a key of their own, so
    that they stay spread over the tasks.
    """
    if as_of.many:
        from ballotlake.operators import many_cuts
        return many_cuts.voting_weights(t, as_of, addresses)
    links, among = links_for(t, as_of), None
    if addresses is not EVERY:
        # Only what the wanted addresses and the members of their links hold is added up.
        wanted = _wanted(t, addresses)
        here = [links.select("id", F.col(c).alias("address")) for c in ("hot", "cold")]
        own = here[0].union(here[1]).join(wanted, "address", "left_semi").select("id").distinct()
        links = links.join(own, "id", "left_semi")
        members = links.select(F.explode(F.array("hot", "cold", "proxy")).alias("address"))
        among = wanted.union(members).distinct()
    return only(set_form_weights(links, ledger(t, as_of, among)), "address", addresses)


def set_form_weights(links: DataFrame, accounts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The weights of all addresses, from the links that count and a ledger."""
    by_proxy = party_rows(weigh_links(links, accounts, by), by).select(
        "address", F.col("total_weight").alias("weight"), *by
    )
    taken = links.select(F.explode(parties()).alias("_key"), *by).distinct()
    unmatched = F.concat(F.lit("\x00"), "account")
    by_balance = (
        own_balances(accounts, by).withColumn("_key", F.coalesce("address", unmatched))
        .join(taken, ["_key", *by], "left_anti")
        .select("address", F.col("balance").alias("weight"), *by)
    )
    return by_proxy.unionByName(by_balance)


def _wanted(t: GovTables, addresses) -> DataFrame:
    """One or several addresses as a column of different ones."""
    if isinstance(addresses, DataFrame):
        return addresses.toDF("address").distinct()
    listed = addresses if isinstance(addresses, (list, tuple, set)) else [addresses]
    return one_column(t.proxy.sparkSession, listed, "address", T.StringType())


# --- row form -------------------------------------------------------------------------------


def _balance_history(t: GovTables) -> DataFrame:
    """Both stored-balance tables as one history, each with its own order."""
    none = F.lit(None)
    wallet = t.wallet_balance.select(
        "address", "block_id", F.col("amount").alias("wallet_amount"), F.col("id").alias("wallet_id"),
        none.cast(AMOUNT).alias("locked_amount"), none.cast("bigint").alias("locked_id"),
    )
    locked = t.locked_balance.select(
        "address", "block_id", none.cast(AMOUNT).alias("wallet_amount"),
        none.cast("bigint").alias("wallet_id"), F.col("amount").alias("locked_amount"),
        F.col("id").alias("locked_id"),
    )
    return wallet.unionByName(locked)


_HELD = [latest("wallet", "wallet_amount", "wallet_id"), latest("locked", "locked_amount", "locked_id")]


def _member(address, wallet: bool = True, locked: bool = True) -> Column:
    return F.struct(
        address.alias("member"), F.lit(wallet).alias("with_wallet"), F.lit(locked).alias("with_locked")
    )


def _weigh(t: GovTables, voters: DataFrame, found: DataFrame, members: Column, cut) -> DataFrame:
    """``voters`` with ``amount``: what their members hold at the cut.

    ``found`` has each different place (address, with ``PER_ROW`` also cut) once, so equal rows of ``voters`` are
    weighed once and each keeps its line, and what else they carry is not copied along.
    """
    place = ["address", "cut_id"] if cut is PER_ROW else ["address"]
    asked = found.select(F.struct(*place).alias("voter"), *place[1:], F.inline(members)).withColumnRenamed("member", "address")
    # Asked twice below: for whose balances to read, and for whom they count.
    asked = settle(asked, "members")
    held = known_at(asked, _balance_history(t), "address", _HELD, cut)
    part = (
        or_zero(F.when(F.col("with_wallet"), F.col("wallet")))
        + or_zero(F.when(F.col("with_locked"), F.col("locked")))
    ).cast(AMOUNT)
    weights = asked.join(held, place, "left").groupBy("voter").agg(F.sum(part).alias("amount")).select("voter.*", "amount")
    return _beside(voters, weights, place)


def _beside(voters: DataFrame, weights: DataFrame, place: list[str]) -> DataFrame:
    """Joined by place, where NULL is a place too."""
    right = weights.select(*[F.col(c).alias(f"_{c}") for c in place], "amount")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place])
    return voters.join(right, same).select(*voters.columns, "amount")


def canonical_weight(t: GovTables, voters: DataFrame, cut, legacy: bool = False) -> DataFrame:
    """``voters`` (column ``address``) with ``amount``, their weight at the cut.

    All columns are kept, and equal rows each get the weight.  A voter counts its
    own wallet and locked balance.  A proxy contract also counts those of its
    hot and of its cold wallet, once if they are the same.  ``legacy`` is the
    rule of old polls: only the wallets of hot and cold, both counted even if
    they are the same.  Balances are the stored ones with the highest id up to
    the cut.
    """
    place = ["address", "cut_id"] if cut is PER_ROW else ["address"]
    contracts = t.proxy.select(
        F.col("vote_proxy").alias("address"), "block_id", "id", F.struct("hot", "cold").alias("pair")
    )
    places = voters.select(*place).distinct()
    pairs = known_at(places, contracts, "address", [latest("pair", "pair", "id")], cut, cut is not PER_ROW)
    own = F.array(_member(F.col("address")))
    if legacy:
        linked = F.array(_member(F.col("pair.hot"), locked=False), _member(F.col("pair.cold"), locked=False))
    else:
        wallets = F.array_distinct(F.array("pair.hot", "pair.cold"))
        linked = F.transform(wallets, lambda wallet: _member(wallet))
    members = F.when(F.col("pair").isNull(), own).otherwise(F.concat(own, linked))
    return _weigh(t, voters, places.join(pairs, place, "left"), members, cut)


def party_weight(t: GovTables, wallets: DataFrame, cut) -> DataFrame:
    """``wallets`` (column ``address``; equal rows each) with ``amount``, seen from the wallet.

    Own wallet and locked balance, the locked balance of the newest proxy
    contract the wallet belongs to, and the wallet balance of its partner.
    """
    place = ["address", "cut_id"] if cut is PER_ROW else ["address"]
    link = F.struct("hot", "cold", "vote_proxy").alias("link")
    history = t.proxy.select(F.explode(parties()).alias("address"), "id", "block_id", link)
    places = wallets.select(*place).distinct()
    links = known_at(places, history, "address", [latest("link", "link", "id")], cut, cut is not PER_ROW)
    partner = F.when(F.col("link.cold") == F.col("address"), F.col("link.hot")).otherwise(
        F.col("link.cold")
    )
    own = F.array(_member(F.col("address")))
    linked = F.array(
        _member(F.col("link.vote_proxy"), wallet=False), _member(partner, locked=False)
    )
    members = F.when(F.col("link").isNull(), own).otherwise(F.concat(own, linked))
    return _weigh(t, wallets, places.join(links, place, "left"), members, cut)
