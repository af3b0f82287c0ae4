"""The de-identification pipeline over a table of messages: detect, rewrite, call a model, restore.

A message row has tenant_id, case_id, thread_id, msg_seq and text, and may have lang. (tenant_id, case_id, thread_id,
msg_seq) orders messages and says whose tokens they share; a null in it is a value like others, and rows that repeat
it are messages of their own. Detection runs once and its spans are stored. Every rewriting but pseudonyms is a narrow
projection; pseudonyms need the numbering of distinct values and a join back, for messages that have any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import actions, spans
from larkspur.functions.shared import dealt, join_null_safe, store, unused
from larkspur.operators import tokens, vault
from larkspur.operators.backends import LABELS, WITH_RECOGNIZERS, SpanPlugin, check_backend, merge_backends, missing_models, recognizers
from larkspur.operators.grammar import Tagger
from larkspur.operators.payload import leaves, walk
from larkspur.operators.rehydrate import rehydrate, rehydrate_chunks, restored
from larkspur.sources.catalog import Catalog, Pattern
from larkspur.sources.languages import LOCALES, Router
from larkspur.sources.profiles import Disposition, Profile, preset
from larkspur.streaming.rehydrate import rehydrate_streaming

CONTEXT = ["tenant_id", "case_id", "thread_id"]
KEY = [*CONTEXT, "msg_seq"]
MODEL_PREFIX = "[mock-model]"
#: What stands for a string of a payload that came back without a rewriting.
LOST = "[REMOVED]"


@dataclass
class Firewall:
    """A profile with its detectors. plugins: further detectors, in the order in which ties go.

    backend: what is run besides the catalogue. All but regex need plug-ins with the labels of their models, and raise
    an error without them; presidio and hybrid also add the ready recognisers. tagger: trims PERSON spans and drops
    those that aren't names by parts of speech; without one, a check of capitals and length stands for it.
    """

    profile: Profile = field(default_factory=lambda: preset("generic"))
    catalog: Catalog = field(default_factory=Catalog.default)
    router: Router = field(default_factory=Router)
    backend: str = "regex"
    plugins: list[SpanPlugin] = field(default_factory=list)
    tagger: Tagger | None = None
    language: str | None = None
    cleanup: bool = True
    ttl: int = vault.DEFAULT_TTL

    @classmethod
    def create(cls, domain: str = "generic", profile: Profile | None = None, language: str | None = None, backend: str = "regex", token_scope: str | None = None, **more: Any) -> Firewall:
        """For a preset domain or a copy of a profile."""
        own = Profile.from_dict((profile or preset(domain)).to_dict())
        if token_scope:
            own.token_scope = token_scope
            own.__post_init__()
        return cls(own, language=language, backend=check_backend(backend), **more)

    # detectors and dispositions of one's own

    def add_pattern(self, pattern: Pattern) -> None:
        self.catalog.add(pattern)

    def add_regex(self, entity_type: str, regex: str, locales: list[str] | None = None, confidence: float = 0.95, context_words: list[str] | None = None, description: str = "", action: str = "pseudonymize", threshold: float = 0.75, parameters: dict[str, Any] | None = None) -> None:
        """A pattern for some locales (all), and what to do with its type unless the profile says so."""
        made = Disposition(entity_type, action, threshold, parameters or {}, description)
        for locale in locales or ["GLOBAL"]:
            self.catalog.add(Pattern(entity_type, locale, regex, confidence, False, tuple(context_words or ()), description))
        if self.profile.get(entity_type) is None:
            self.profile.add(made)

    def add_plugin(self, plugin: SpanPlugin) -> None:
        self.plugins.append(plugin)

    def detectors(self) -> list[str]:
        """Names of the detectors: pattern groups of the catalogue, and plug-ins."""
        return [f"{t}:{where}" for t, where in self.catalog.groups] + [p.name for p in self.plugins]

    def remove_detector(self, name: str) -> int:
        """Take a pattern group (TYPE:LOCALE) or a plug-in out; how many patterns or plug-ins that were."""
        if ":" in name and tuple(name.split(":", 1)) in self.catalog.groups:
            return self.catalog.remove(*name.split(":", 1))
        before = len(self.plugins)
        self.plugins = [p for p in self.plugins if p.name != name]
        return before - len(self.plugins)

    def supported_entities(self, locale: str | None = None) -> set[str]:
        """Types that patterns or plug-ins can find."""
        return self.catalog.entity_types(locale) | {t for p in self.plugins for t in LABELS[p.labels].values()}

    def export_profile(self) -> dict[str, Any]:
        return self.profile.to_dict()

    # stages

    def _checked(self, messages: DataFrame) -> DataFrame:
        if missing := [c for c in [*KEY, "text"] if c not in messages.columns]:
            raise ValueError(f"messages lack the columns {', '.join(missing)}")
        return messages

    def _language(self, messages: DataFrame) -> Column:
        own = F.lit(self.language) if self.language else F.col("lang") if "lang" in messages.columns else F.lit(None)
        return own.cast("string").alias("_lang")

    def with_spans(self, messages: DataFrame, filtered: bool = True) -> DataFrame:
        """The messages with locale and spans: overlaps resolved, neighbouring persons joined, the profile applied."""
        rows = self._checked(messages)
        return self._detected(rows.select("*", self._language(rows)), filtered).drop("_lang")

    def _detected(self, rows: DataFrame, filtered: bool = True) -> DataFrame:
        """with_spans for rows with a column _lang."""
        rows = rows.withColumn("locale", F.expr(self.router.locale_sql("_lang")))
        if missing := missing_models(self.backend, self.plugins, list(self.profile.dispositions)):
            raise ValueError(f"backend {self.backend!r} needs plug-ins with the labels {', '.join(missing)}")
        rows = rows.withColumn("_0", spans.detect(self.catalog))
        found = ["_0"]
        if self.backend in WITH_RECOGNIZERS:
            spanish = F.col("locale") == LOCALES["es"]
            rows = rows.withColumn("_r", F.when(spanish, spans.detect(recognizers("es"))).otherwise(spans.detect(recognizers())))
            found.append("_r")
        for k, plugin in enumerate(self.plugins, 1):
            rows = plugin.add_spans(rows, out=f"_{k}")
            found.append(f"_{k}")
        merged = merge_backends(*found) if len(found) > 1 else F.col("_0")
        rows = rows.withColumn("_m", merged)
        people = bool(self.plugins) or "PERSON" in self.catalog.entity_types()
        if self.tagger and people:
            rows = self.tagger.trim(rows, "_m").withColumn("_m", F.array_sort("_m"))
        resolved = spans._bind(spans.dedupe_sql("_m"), "d", spans.merge_persons_sql("d") if self.plugins else "d")
        if self.profile.linguistic_filter and people:
            if self.tagger:
                rows = self.tagger.judge(rows.withColumn("_m", F.expr(resolved)), "_m")
                resolved = "_m"
            else:
                resolved = spans._bind(resolved, "h", spans.heuristic_filter_sql("h"))
        if filtered:
            resolved = spans.profile_filter_sql(resolved, self.profile)
        return rows.withColumn("spans", F.expr(resolved)).drop("_m", *found)

    def mentions(self, detected: DataFrame, *more: str) -> DataFrame:
        """The spans that get pseudonyms, a row each."""
        rows = detected.select(*more, *KEY, F.explode(F.filter("spans", lambda s: s["entity_type"].isin(self._tokened()))).alias("s"))
        return rows.select(*more, *KEY, "s.start", "s.end", "s.entity_type", "s.text")

    def _tokened(self) -> list[str]:
        return [t for t in self.profile.dispositions if self.profile.should_pseudonymize(t)]

    def _tokens(self, mentions: DataFrame, registry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(the registry, mentions with their tokens), stored. Persons match fuzzily if a plug-in can find them.

        The registry is stored before the mentions look their tokens up, else values would be numbered twice.
        """
        scope = self.profile.token_scope
        fuzzy = bool(self.plugins) or "PERSON" in self.catalog.entity_types() or self.backend in WITH_RECOGNIZERS
        exact = mentions.where("entity_type <> 'PERSON'") if fuzzy else mentions
        known = store(tokens.resolve_exact(exact, scope, registry), "registry").df
        named = mentions.withColumn("scope", tokens.scope_key(scope)).withColumn("canonical", tokens.canonical())
        told = join_null_safe(named.where("entity_type <> 'PERSON'") if fuzzy else named, known.select(*tokens.REGISTRY, "canonical", "token"), [*tokens.REGISTRY, "canonical"])
        if fuzzy:
            people = store(tokens.resolve_persons(mentions, scope, self.profile.similarity_threshold, registry).withColumn("entity_type", F.lit("PERSON")), "persons").df
            persons = join_null_safe(named.drop("canonical").where("entity_type = 'PERSON'"), people.select("tenant_id", "scope", "text", "canonical", "token"), ["tenant_id", "scope", "text"])
            told = told.unionByName(persons.select(*told.columns))
            found = people.select(*known.columns).distinct()
            known = store(known.unionByName(found if registry is None else join_null_safe(found, registry.select("tenant_id", "scope", "token"), ["tenant_id", "scope", "token"], "left_anti")), "registry").df
        return known, store(told, "told").df

    def _expiry(self, now: int) -> Column:
        """When a mention's vault row expires: by the ttl_seconds of its type's disposition, else by the firewall's."""
        own = [(d.entity_type, d.parameters["ttl_seconds"]) for d in self.profile.dispositions.values() if "ttl_seconds" in d.parameters]
        ttl = F.lit(self.ttl)
        for entity_type, seconds in own:
            ttl = F.when(F.col("entity_type") == entity_type, F.lit(None if seconds is None else int(seconds))).otherwise(ttl)
        return vault.expiry(now, ttl)

    def anonymize(self, messages: DataFrame, now: int = 0, registry: DataFrame | None = None) -> Anonymized:
        """Rewrite messages. now: the time that expiry counts from; registry: tokens of earlier runs.

        Returns the columns of the messages, sanitized_text and trace (which replace columns of these names). Messages
        are dealt out to all cores and stored once with their spans; numbering and rewriting read them from there. A span that gets a pseudonym
        but for which no token is found becomes [TYPE]: the original never goes out.
        """
        checked = self._checked(messages)
        names = [c for c in messages.columns if c not in ("sanitized_text", "trace")]
        # columns that are only passed on go by numbers inside, so that none can meet a name of ours
        inner = {c: f"_c{i}" for i, c in enumerate(names) if c not in [*KEY, "text"]}
        rows = dealt(checked).select(*KEY, "text", self._language(checked), *[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
        detected = self._detected(rows).withColumn("_row", F.monotonically_increasing_id()).withColumn("_tokened", F.exists("spans", lambda s: s["entity_type"].isin(self._tokened())))
        kept_rows = store(detected, "detected").df
        some = kept_rows.where("_tokened")
        known, told = self._tokens(store(self.mentions(some, "_row"), "mentions").df, registry)
        given = told.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("start", "token"))).alias("_tokens"))
        none = F.lit(None).cast("map<int,string>").alias("_tokens")
        rows = some.join(given, "_row", "left").unionByName(kept_rows.where("not _tokened").select("*", none))
        token = "coalesce(try_element_at(_tokens, x.start), concat('[', x.entity_type, ']'))"
        parts = f"transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'to', {actions.replacement_sql(self.profile, 'x', token)}, 'entity_type', x.entity_type, 'source', x.source, 'from', x.text))"
        rows = rows.withColumn("_parts", F.expr(parts)).withColumn("_out", F.expr(actions.splice_sql("text", "_parts")))
        kept = [t for t in self.profile.dispositions if self.profile.should_keep(t)]
        clean = self.cleanup and self.profile.defensive_cleanup
        rows = rows.withColumn("sanitized_text", F.expr(actions.residual_sql("_out")) if clean else F.col("_out"))
        warn = F.expr(f"if({actions.has_residual_sql('sanitized_text')}, array('residual entities after {actions.PASSES} passes'), cast(array() as array<string>))") if clean else F.array().cast("array<string>")
        acts = F.create_map(*[F.lit(v) for d in self.profile.dispositions.values() for v in (d.entity_type, d.action)]) if self.profile.dispositions else F.create_map(F.lit(""), F.lit(""))
        replaced = F.transform(F.filter("_parts", lambda p: ~p["entity_type"].isin(kept)), lambda p: F.struct(p["entity_type"], p["source"], p["from"], p["to"], acts[p["entity_type"]].alias("action"), p["start"], p["end"]))
        trace = F.struct(F.sha2(F.to_json(F.struct(*[F.col(k).cast("string") for k in KEY])), 256).substr(1, 32).alias("trace_id"), F.col("tenant_id"), F.col("case_id"), F.lit(self.profile.name).alias("policy_mode"), F.col("spans").alias("detected_entities"), replaced.alias("replacements"), F.filter("spans", lambda s: s["entity_type"].isin(kept)).alias("entities_kept"), F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("block_reason"), warn.alias("cleanup_warnings"), F.col("locale"))
        puts = told.select(*CONTEXT, "token", F.col("text").alias("original"), self._expiry(now).alias("expires_at"), F.struct("msg_seq", (-F.col("start")).alias("back")).alias("seq"))
        out = [F.col(inner[c]).alias(c) if c in inner else F.col(c) for c in names]
        return Anonymized(rows.select(*out, "sanitized_text", trace.alias("trace")), known, vault.latest(puts))

    def secure_call(self, messages: DataFrame, model: Callable[[Column], Column] | None = None, now: int = 0, registry: DataFrame | None = None) -> DataFrame:
        """Rewrite, ask a model (an expression on the rewritten text; none: the text itself), and restore its answer."""
        made = self.anonymize(messages, now, registry)
        answer = model(F.col("sanitized_text")) if model else F.col("sanitized_text")
        return rehydrate(made.messages.withColumn("model_output", answer), vault.mapping(made.vault, now), "model_output")

    def secure_call_stream(self, messages: DataFrame, answers: Callable[[DataFrame], DataFrame], now: int = 0, registry: DataFrame | None = None) -> tuple[Anonymized, DataFrame]:
        """Rewrite messages, and restore the answers that a model gives in chunks.

        answers: from the rewritten messages to a table or stream (tenant_id, case_id, thread_id, chunk_seq, chunk,
        last). Of a stream the restored chunks are a stream too, with what may be the beginning of a token held back;
        of a table they are one text for each thread.
        """
        made = self.anonymize(messages, now, registry)
        chunks, mappings = answers(made.messages), vault.mapping(made.vault, now)
        return made, rehydrate_streaming(chunks, mappings) if chunks.isStreaming else rehydrate_chunks(chunks, mappings)

    def anonymize_payload(self, rows: DataFrame, column: str, now: int = 0, registry: DataFrame | None = None) -> tuple[DataFrame, Anonymized]:
        """Rewrite all strings in a nested column of rows (tenant_id, case_id, thread_id, msg_seq, column).

        Each string is a message of its own, ordered from left to right in its row; the rewritten ones go back by
        their place. A string of which no rewriting comes back becomes LOST.
        """
        kind, lang = rows.schema[column].dataType, [c for c in ("lang",) if c in rows.columns]
        number = unused("_payload", rows.columns)
        own = store(dealt(rows).withColumn(number, F.monotonically_increasing_id()), "payloads").df
        listed = own.select(F.col(number).alias("_payload"), *KEY, *lang, F.posexplode(leaves(F.col(column), kind)).alias("_at", "text"))
        made = self.anonymize(listed.select("_payload", *CONTEXT, F.struct("msg_seq", "_at").alias("msg_seq"), *lang, "text"), now, registry)
        # equal strings of a payload are rewritten alike, so a map from the old to the new text restores the shape
        new_texts = made.messages.where("text is not null").groupBy(F.col("_payload").alias(number), "text").agg(F.min("sanitized_text").alias("to"))
        changed = new_texts.groupBy(number).agg(F.map_from_entries(F.collect_list(F.struct("text", "to"))).alias("_new"))
        new_name = unused("_new", rows.columns)
        joined = own.join(changed.withColumnRenamed("_new", new_name), number, "left")
        new = walk(F.col(f"`{column}`"), kind, lambda leaf: F.when(leaf.isNotNull(), F.coalesce(F.try_element_at(F.col(new_name), leaf), F.lit(LOST))))
        return joined.withColumn(column, new).drop(number, new_name), made

    def rehydrate_payload(self, rows: DataFrame, column: str, mappings: DataFrame) -> DataFrame:
        """Restore all strings in a nested column of rows (tenant_id, case_id, thread_id, column) by the mappings of their threads."""
        name = unused("_mapping", rows.columns)
        joined = join_null_safe(rows, mappings.select(*CONTEXT, F.col("mapping").alias(name)), CONTEXT, "left")
        new = walk(F.col(f"`{column}`"), rows.schema[column].dataType, lambda leaf: F.when(F.col(name).isNull(), leaf).otherwise(restored(leaf, F.col(name))))
        return joined.withColumn(column, new).drop(name)


@dataclass
class Anonymized:
    """Rewritten messages with their trace, the token registry, and the vault rows to keep."""

    messages: DataFrame
    registry: DataFrame
    vault: DataFrame


def mock_model(prompt: Column) -> Column:
    """A stand-in for a model: its prefix and the prompt."""
    return F.concat_ws(" ", F.lit(MODEL_PREFIX), prompt)
