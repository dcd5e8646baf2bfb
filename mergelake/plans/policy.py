"""Apply policies and signatures: decisions over whole batches, frames in and frames out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelake.functions.codec import legacy_preimage, preimage
from mergelake.operators.schema import EngineError


class SignatureError(EngineError):
    """A signed change doesn't verify."""


class SignatureProvider:
    """Signs and verifies. verify gets preimage and signature (JSON text) as Columns; use an Arrow pandas UDF where the JVM has no function."""

    def author(self) -> str:
        return ""

    def sign(self, data: Column) -> Column:
        """Signature (JSON text) of a preimage; null to leave it unsigned."""
        return F.lit(None).cast("string")

    def verify(self, data: Column, sig: Column) -> Column:
        raise NotImplementedError

    def before_apply(self, batch: DataFrame) -> None:
        """Sees the batch before any signature is checked; may raise to refuse it."""


class NoSignatures(SignatureProvider):
    """Accepts changes without a signature, or with a null one."""

    def verify(self, data: Column, sig: Column) -> Column:
        return sig == "null"


class DigestSignatures(SignatureProvider):
    """Keyed SHA-256, all in the JVM: {"author":…,"digest":…} over secret and preimage."""

    def __init__(self, author: str, secrets: dict[str, str]):
        self._author, self._secrets = author, secrets

    def author(self) -> str:
        return self._author

    def _digest(self, secret: Column, data: Column) -> Column:
        key = F.encode(secret, "UTF-8")
        return F.sha2(F.concat(key, F.unhex(F.sha2(F.concat(key, data), 256))), 256)

    def sign(self, data: Column) -> Column:
        return F.to_json(F.struct(F.lit(self._author).alias("author"), self._digest(F.lit(self._secrets[self._author]), data).alias("digest")))

    def verify(self, data: Column, sig: Column) -> Column:
        said = F.from_json(sig, "author string, digest string")
        secret = F.create_map(*[F.lit(x) for kv in self._secrets.items() for x in kv])[said["author"]]
        return F.coalesce(self._digest(secret, data) == said["digest"], F.lit(False))


def change_preimage() -> Column:
    return preimage(*(F.col(c) for c in ("table_name", "row_pks", "column_name", "hlc_timestamp", "value")))


def unverified(batch: DataFrame, provider: SignatureProvider) -> DataFrame:
    """Signed changes that verify neither by the current nor by the older preimage: input_index."""
    parts = [F.col(c) for c in ("table_name", "row_pks", "column_name", "hlc_timestamp", "value")]
    good = provider.verify(change_preimage(), F.col("sig")) | F.coalesce(provider.verify(legacy_preimage(*parts), F.col("sig")), F.lit(False))
    return batch.filter(F.col("sig").isNotNull()).filter(~F.coalesce(good, F.lit(False))).select("input_index")


class ApplyPolicy:
    """Hooks of a merge. Each sees frames, not rows; order across rows isn't defined."""

    def preflight(self, batch: DataFrame) -> None:
        """Before anything is merged; may raise."""

    def reject(self, batch: DataFrame) -> DataFrame | None:
        """input_index of changes to leave out; None for none."""
        return None

    def after_merge(self, table: str, classified: DataFrame) -> None:
        """After a table's rows are merged."""

    def on_constraint(self) -> str:
        """abort or skip, when rows can't be inserted. Skipping loses them, so it has to be asked for."""
        return "abort"

    def before_commit(self, outcome) -> None:
        """Last chance to raise."""


class SignaturePolicy(ApplyPolicy):
    """The default: every signed change must verify, the first that doesn't refuses the batch."""

    def __init__(self, provider: SignatureProvider | None = None):
        self.provider = provider or NoSignatures()

    def preflight(self, batch: DataFrame) -> None:
        self.provider.before_apply(batch)
        first = unverified(batch, self.provider).agg(F.min("input_index")).first()[0]
        if first is not None:
            raise SignatureError(f"change {first} doesn't verify")


Observer = Callable[[list[str]], None]
