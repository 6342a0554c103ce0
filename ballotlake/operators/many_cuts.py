"""Balances, proxy links and set-form weights as of many blocks or times, in one job.

``balances``, ``proxies`` and ``weights`` call these when the as-of holds a DataFrame of requests (``unix(df)``,
``block(df)``).  Each result has the request in its first column, ``unix`` or ``number``; a request before the first block has no
rows.  Transfers, locks and links are read once, however many requests there are (see ``functions/cuts.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotlake.functions.asof import EVERY, AsOf, only
from ballotlake.functions.cuts import CUT, at_every_cut, mark_first_cut, numbered, until_next
from ballotlake.functions.settle import settle
from ballotlake.functions.times import first_second_at
from ballotlake.model import AMOUNT, RESULT, GovTables
from ballotlake.operators.balances import own_balances, transfer_sides
from ballotlake.operators.proxies import parties
from ballotlake.operators.weights import party_rows, set_form_weights, weigh_links
from ballotlake.sources.located import at_block

#: Zones of 4096 seconds or 65536 numbers.
_BITS = {"unix": 12, "block": 16}
_NAME = {"unix": "unix", "block": "number"}


class Cuts:
    """The requests of an as-of, numbered, each with the greatest id of the blocks in range."""

    def __init__(self, t: GovTables, as_of: AsOf):
        self.t, self.kind = t, as_of.kind
        asked = settle(numbered(as_of.value), "asked")
        self.n, self.least = asked.agg(F.count("*"), F.min("value")).first()
        blocks = t.block.select("id", F.col("number").alias("block_number"), "block_ts")
        newest = self._marked(blocks, asked).groupBy(CUT).agg(F.max("id").alias("id"))
        so_far = F.max("id").over(Window.orderBy(CUT))
        # Small, and part of every branch below.
        self.table = settle(asked.join(newest, CUT, "left").select("value", CUT, so_far.alias("upto")), "cuts")
        self.least_id = self.table.agg(F.min("upto")).first()[0]

    def _marked(self, facts: DataFrame, cuts: DataFrame) -> DataFrame:
        place = F.col("block_number") if self.kind == "block" else first_second_at(F.col("block_ts"))
        placed = facts.withColumn("_place", place)
        return mark_first_cut(placed, "_place", cuts, self.least, "value", _BITS[self.kind]).drop("_place")

    def marked(self, facts: DataFrame) -> DataFrame:
        """Facts with the place of their block, marked with the first cut they count for."""
        return self._marked(facts, self.table)

    def marked_by_id(self, facts: DataFrame) -> DataFrame:
        """Facts marked by their block's id, which is compared with the greatest id in range."""
        return mark_first_cut(facts, "block_id", self.table, self.least_id, "upto")

    def named(self, rows: DataFrame, *columns) -> DataFrame:
        """``rows`` with the request in place of its number."""
        asked = self.table.select(F.col("value").alias(_NAME[self.kind]), CUT)
        return rows.join(asked, CUT).select(_NAME[self.kind], *columns)


def _wallet_moves(cuts: Cuts) -> DataFrame:
    moved = cuts.marked_by_id(cuts.t.transfer.select("sender", "receiver", "amount", "block_id"))
    return moved.select(CUT, transfer_sides())


def _lock_moves(cuts: Cuts) -> DataFrame:
    placed = at_block(cuts.t.lock, cuts.t.block).select("immediate_caller", "lock_amt", "block_number", "block_ts")
    return cuts.marked(placed).select(CUT, F.col("immediate_caller").alias("address"), F.col("lock_amt").alias("change"))


def _so_far(changed: DataFrame, sums: list[str], flags: list[str], cuts: Cuts) -> DataFrame:
    """Changes per address and cut, as states that hold until the address's next change."""
    upto = Window.partitionBy("address").orderBy(CUT).rowsBetween(Window.unboundedPreceding, 0)
    states = changed.select(
        "address", CUT, *[F.sum(c).over(upto).cast(AMOUNT).alias(c) for c in sums], *[F.max(c).over(upto).alias(c) for c in flags])
    return until_next(states, ["address"], cuts.n)


def ledger(cuts: Cuts) -> DataFrame:
    """``balances.ledger`` at every cut, by intervals: (address, _cut, _until, moved, locked, holder)."""
    none = F.lit(None).cast("decimal(28,18)")
    wallet = _wallet_moves(cuts).withColumn("locked", none)
    locked = _lock_moves(cuts).select(
        CUT, "address", none.alias("change"), F.lit(False).alias("received"), F.col("change").alias("locked"))
    known = wallet.unionByName(locked).where(F.col("address").isNotNull())
    changed = known.groupBy("address", CUT).agg(
        F.sum("change").cast(AMOUNT).alias("moved"), F.sum("locked").cast(AMOUNT).alias("locked"),
        F.bool_or("received").alias("holder"))
    return _so_far(changed, ["moved", "locked"], ["holder"], cuts)


def token_holders(t: GovTables, as_of: AsOf) -> DataFrame:
    cuts = Cuts(t, as_of)
    changed = _wallet_moves(cuts).groupBy("address", CUT).agg(
        F.sum("change").cast(AMOUNT).alias("balance"), F.bool_or("received").alias("received"))
    return cuts.named(at_every_cut(_so_far(changed, ["balance"], ["received"], cuts).where("received")),
                      "address", F.col("balance").cast(RESULT).alias("balance"))


def locked_balances(t: GovTables, as_of: AsOf) -> DataFrame:
    cuts = Cuts(t, as_of)
    changed = _lock_moves(cuts).groupBy("address", CUT).agg(F.sum("change").cast(AMOUNT).alias("balance"))
    return cuts.named(at_every_cut(_so_far(changed, ["balance"], [], cuts)), "address", F.col("balance").cast(RESULT).alias("balance"))


def combined_balances(t: GovTables, as_of: AsOf) -> DataFrame:
    cuts = Cuts(t, as_of)
    return cuts.named(own_balances(at_every_cut(ledger(cuts)), [CUT]), "address", "balance")


def active_links(cuts: Cuts) -> DataFrame:
    """(id, hot, cold, proxy, _cut, _until): the links that are the latest by block for both of their wallets, by intervals of cuts.

    A wallet's newest link block only grows from cut to cut, so each value of it holds for one interval of cuts.  A link
    counts in the common part of the intervals of its two wallets that its own block opened.
    """
    placed = at_block(cuts.t.proxy, cuts.t.block).select("id", "hot", "cold", "vote_proxy", "block_id", "block_number", "block_ts")
    links = cuts.marked(placed).select("id", "hot", "cold", F.col("vote_proxy").alias("proxy"), "block_id", CUT)
    newest = links.select(F.explode(parties()).alias("party"), CUT, "block_id").groupBy("party", CUT).agg(
        F.max("block_id").alias("block_id"))
    earlier = Window.partitionBy("party").orderBy(CUT).rowsBetween(Window.unboundedPreceding, -1)
    opened = newest.withColumn("_before", F.max("block_id").over(earlier)).where(
        F.col("_before").isNull() | (F.col("block_id") > F.col("_before")))
    intervals = until_next(opened.drop("_before"), ["party"], cuts.n)
    for wallet in ("hot", "cold"):
        own = intervals.select(F.col("party").alias(wallet), CUT, "block_id", F.col("_until").alias(f"_{wallet}_until"))
        links = links.join(own, [wallet, CUT, "block_id"])
    return links.select("id", "hot", "cold", "proxy", CUT, F.least("_hot_until", "_cold_until").alias("_until"))


def active_proxies(t: GovTables, as_of: AsOf) -> DataFrame:
    cuts = Cuts(t, as_of)
    return cuts.named(at_every_cut(active_links(cuts)), "hot", "cold", "proxy")


def proxy_weights(t: GovTables, as_of: AsOf) -> DataFrame:
    cuts = Cuts(t, as_of)
    weights = weigh_links(at_every_cut(active_links(cuts)), at_every_cut(ledger(cuts)), [CUT])
    return cuts.named(weights, "hot", "cold", "proxy", F.col("total_weight").cast(RESULT).alias("total_weight"))


def party_weights(t: GovTables, as_of: AsOf) -> DataFrame:
    cuts = Cuts(t, as_of)
    return cuts.named(party_rows(weigh_links(at_every_cut(active_links(cuts)), at_every_cut(ledger(cuts)), [CUT]), [CUT]), "address", "total_weight")


def voting_weights(t: GovTables, as_of: AsOf, addresses=EVERY) -> DataFrame:
    cuts = Cuts(t, as_of)
    # Both take part twice; written as intervals they have no more rows than there were changes.
    links, accounts = settle(active_links(cuts), "links"), settle(ledger(cuts), "ledger")
    weights = set_form_weights(at_every_cut(links), at_every_cut(accounts), [CUT])
    return only(cuts.named(weights, "address", "weight"), "address", addresses)


