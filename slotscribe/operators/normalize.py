"""Blocks -> flat transactions -> routed instruction calls -> touched accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.base58 import base58_decode
from ..functions.discriminators import discriminator_hex, leading_discriminator
from ..sources.blocks import first_signature, uses_program
from .registry import Program


def transactions(blocks: DataFrame, program_id: str | None) -> DataFrame:
    """One flat row per transaction that mentions the program, or per transaction without one.

    Transactions without a signature, without meta or in parsed form are left
    out. Failed transactions stay, with their error. Account keys are the
    static ones followed by the loaded writable and loaded readonly ones.

    Explode and filter run in one generated loop, so transactions of other
    programs are skipped without being copied.
    """
    none = F.array().cast("array<string>")
    return (
        blocks.select("slot", "block_time", F.posexplode("transactions").alias("tx_index", "tx"))
        .where(F.lit(True) if program_id is None else uses_program(F.col("tx.account_keys"), program_id))
        .where(F.col("tx.meta").isNotNull() & ~F.coalesce("tx.parsed", F.lit(False)))
        .select(
            first_signature(F.col("tx.signatures")).alias("signature"),
            "slot",
            "block_time",
            "tx_index",
            F.col("tx.meta.err").alias("err"),
            F.concat(
                F.coalesce("tx.account_keys", none),
                F.coalesce("tx.meta.loaded_writable", none),
                F.coalesce("tx.meta.loaded_readonly", none),
            ).alias("accounts"),
            "tx.header",
            "tx.instructions",
        )
        .where(F.col("signature").isNotNull())
    )


def account_at(accounts: Column | str, index: Column) -> Column:
    """Account key at an index; NULL when out of range."""
    return F.get(F.col(accounts) if isinstance(accounts, str) else accounts, index)


def resolve_accounts(accounts: Column | str, indices: Column) -> Column:
    """Addresses of an index list; indices out of range are dropped."""
    return F.filter(F.transform(indices, lambda i: account_at(accounts, i)), lambda a: a.isNotNull())


def account_roles(accounts: Column, indices: Column, header: Column) -> Column:
    """(pubkey, is_signer, is_writable) per index, from the header counts; out-of-range indices are dropped."""
    zero = F.lit(0)
    signers = header["num_required_signatures"]
    writable_signers = F.greatest(zero, signers - header["num_readonly_signed"])
    others = F.greatest(zero, F.size(accounts) - signers)
    writable_others = F.greatest(zero, others - header["num_readonly_unsigned"])

    def role(i: Column) -> Column:
        signs = i < signers
        writes = F.when(signs, i < writable_signers).otherwise(F.greatest(zero, i - signers) < writable_others)
        return F.struct(account_at(accounts, i).alias("pubkey"), signs.alias("is_signer"), writes.alias("is_writable"))

    return F.filter(F.transform(indices, role), lambda r: r["pubkey"].isNotNull())


def calls(txs: DataFrame, program_id: str) -> DataFrame:
    """One row per top-level instruction of the program, with its payload as bytes.

    Payload text that is not base58 becomes an empty payload.
    """
    extra = [c for c in ("list_order",) if c in txs.columns]
    exploded = txs.select(
        F.col("signature").alias("tx_sig"), *extra, "slot", "block_time", "tx_index", "accounts",
        F.posexplode("instructions").alias("ix_index", "ix"),
    ).where(account_at("accounts", F.col("ix.program_id_index")) == F.lit(program_id))
    return exploded.select(
        "tx_sig", *extra, "slot", "block_time", "tx_index", "ix_index",
        resolve_accounts("accounts", F.col("ix.accounts")).alias("touched"),
        base58_decode(F.col("ix.data")).alias("data"),
    )


def route(payloads: DataFrame, program: Program, kind: str, *, data: str = "data") -> DataFrame:
    """Add ``entry_name`` and ``table_name`` by discriminator; both NULL when nothing matches.

    The routing table holds at most ``MAX_ENTRIES`` rows of one program, so it
    is always small enough to broadcast; payload rows never move.
    """
    table = F.broadcast(program.routing_table(payloads.sparkSession, kind))
    return payloads.withColumn("discriminator", leading_discriminator(F.col(data))).join(table, "discriminator", "left")


def quarantine(routed: DataFrame, *, data: str = "data") -> DataFrame:
    """Calls that reach no table: unknown discriminator, or a known type without a table."""
    return routed.where(F.col("table_name").isNull()).select(
        "tx_sig", "slot", "ix_index",
        F.coalesce(discriminator_hex(F.col(data)), F.lit("")).alias("discriminator_hex"),
        F.when(F.col("entry_name").isNull(), "unknown_discriminator").otherwise("no_table").alias("reason"),
    )


def unknown_counts(routed: DataFrame, *, data: str = "data") -> DataFrame:
    """Calls per unknown discriminator (the whole payload when shorter than eight bytes)."""
    return (
        routed.where(F.col("entry_name").isNull())
        .groupBy(F.coalesce(discriminator_hex(F.col(data)), F.lit("")).alias("discriminator_hex"))
        .agg(F.count(F.lit(1)).alias("calls"))
    )


def touched_accounts(routed: DataFrame, order: str | None = None) -> DataFrame:
    """(address, slot, tx_index, ix_index) for every account of a decoded instruction."""
    kept = ["slot", "tx_index", "ix_index", *([order] if order else [])]
    return routed.where(F.col("entry_name").isNotNull()).select(F.explode("touched").alias("address"), *kept)


def first_touch(touches: DataFrame, order: str | None = None, *, newest_first: bool = False) -> DataFrame:
    """(address, slot): the slot of the first touch in processing order.

    By default that is slot order, a plain minimum (or maximum) of one long, so
    the aggregation is a hash aggregation with partial results; ``order`` names
    another numeric processing order.
    """
    if order is not None:
        slot = F.min_by("slot", order)
    else:
        slot = F.max("slot") if newest_first else F.min("slot")
    return touches.groupBy("address").agg(slot.alias("slot"))


# Parts that the versions of one address are dealt into when they are joined by shuffle.
VERSION_PARTS = 16


def _versions(touches: DataFrame, snapshots: DataFrame, spread: bool) -> DataFrame:
    """Every touched address with all its versions.

    ``spread`` deals the versions of an address over several tasks and repeats
    its touch, one row, in each; a broadcast join needs neither.
    """
    versions = snapshots.select("address", F.col("slot").alias("_version"), "lamports", "data")
    if not spread:
        return touches.join(versions, "address")
    part = F.pmod(F.xxhash64("_version"), F.lit(VERSION_PARTS)).alias("_part")
    repeated = touches.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(VERSION_PARTS - 1).cast("bigint"))))
    return repeated.join(versions.select("*", part), ["address", "_part"]).drop("_part")


def current_snapshots(first_touches: DataFrame, snapshots: DataFrame, *, spread: bool = False) -> DataFrame:
    """Touched accounts joined to their snapshot (address, lamports, data), stamped with the touching slot.

    Addresses without a snapshot drop out. Where ``snapshots`` has a ``slot``
    there may be several versions of an account, and the newest one counts.
    """
    if "slot" not in snapshots.columns:
        return first_touches.join(snapshots.select("address", "lamports", "data"), "address")
    return _newest_version(_versions(first_touches, snapshots, spread))


def _newest_version(joined: DataFrame) -> DataFrame:
    """One row per address, trimmed in each map task before the shuffle."""
    newest = F.row_number().over(Window.partitionBy("address").orderBy(F.desc("_version")))
    return joined.withColumn("_rn", newest).where("_rn = 1").drop("_rn", "_version")


def snapshots_as_of(first_touches: DataFrame, snapshots: DataFrame, *, spread: bool = False) -> DataFrame:
    """Like ``current_snapshots`` for versioned snapshots: the newest version not after the touch.

    Each address has one touch, so the join emits each snapshot at most once;
    the row-number filter trims to one row per address before its shuffle.
    """
    return _newest_version(_versions(first_touches, snapshots, spread).where(F.col("_version") <= F.col("slot")))
