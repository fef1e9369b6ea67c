"""Payload versions, heads, citation keys and the project registry.

A version row is ``id, hash, session_uuid, project_id, last_ts, captured_at ...``
where ``id`` is the insertion order. A payload is its sha256, never its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import paths
from threadline.operators.ordered import position, previous_row, running_max, top_per_key

DUPLICATE_WINDOW_SECONDS = 10
ID_CHUNK = 1 << 20


# ---- payload identity -------------------------------------------------------


def keep_largest(listing: DataFrame) -> DataFrame:
    """One file per identity: the largest, then the archived copy, then the first path.

    Works on listing metadata alone, so losing files are never opened.
    """
    rank = [-F.col("size_bytes"), (F.col("source_tree") != "archive").cast("int"), F.col("path")]
    return top_per_key(listing, ["key"], rank)


def payload_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def grew_by_append(content: Column, old_size: Column, old_hash: Column) -> Column:
    """The new bytes are the old bytes plus more: the hash of that many leading bytes is the old hash."""
    head = F.sha2(F.substring(content, F.lit(1), old_size.cast("int")), 256)
    return F.coalesce((F.octet_length(content) > old_size) & (head == old_hash), F.lit(False))


def unknown_payloads(payloads: DataFrame, versions: DataFrame) -> DataFrame:
    """Payloads whose hash the catalogue does not hold; the prefilter of every sweep."""
    return payloads.join(versions.select("hash"), "hash", "left_anti")


def put_new(payloads: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append to a content-addressed store: one per hash, none already present."""
    return top_per_key(unknown_payloads(payloads, stored), ["hash"], [F.col("id")])


def content_history(copies: DataFrame, history: DataFrame) -> DataFrame:
    """Contents of a path never recorded before; appended, so nothing is ever removed."""
    fresh = copies.join(history.select("path", "hash"), ["path", "hash"], "left_anti")
    return top_per_key(fresh, ["path", "hash"], [F.col("seen_at"), F.col("id")])


def latest_content(history: DataFrame) -> DataFrame:
    return top_per_key(history, ["path"], [-F.unix_micros("seen_at"), -F.col("id")])


# ---- version chains ---------------------------------------------------------


def chain_of(uuid: str = "session_uuid") -> Column:
    # A row without a session id is a chain of its own.
    return F.coalesce(F.col(uuid), F.concat(F.lit("row-"), F.col("id")))


def _recency() -> Column:
    return F.struct(
        F.coalesce("last_ts", "captured_at").alias("at"), F.col("captured_at").alias("captured"), F.col("id").alias("id")
    )


def heads(versions: DataFrame, weight: str | None = None) -> DataFrame:
    """The latest version of every session by payload time, with ``n_versions``.

    ``weight`` names a column that says how many versions a row stands for.

    One ``max_by`` per chain, combined on the map side: a chain that holds a
    third of all versions still reduces to one row per task before the shuffle.
    """
    row = F.struct(*[c for c in versions.columns if c != weight])
    best = versions.groupBy(chain_of().alias("_chain")).agg(
        F.max_by(row, _recency()).alias("_row"), (F.sum(weight) if weight else F.count(F.lit(1))).alias("n_versions")
    )
    return best.select("_row.*", "n_versions")


def visible_heads(versions: DataFrame) -> DataFrame:
    return heads(versions).where("hidden = 0")


def multi_version_heads(versions: DataFrame) -> DataFrame:
    return heads(versions).where("session_uuid is not null and n_versions >= 2")


def with_project(versions: DataFrame, project: DataFrame) -> DataFrame:
    """Version rows with the label of their project."""
    return versions.join(project.select(F.col("id").alias("project_id"), "label"), "project_id")


def supersedes(versions: DataFrame, chunk: int = ID_CHUNK) -> DataFrame:
    """``supersedes``: the version that was latest when this one was inserted."""
    keyed = versions.withColumn("_k", chain_of())
    ranked = F.struct(
        F.coalesce("last_ts", "captured_at").alias("at"), F.col("captured_at"), F.col("id"), F.col("hash")
    )
    linked = running_max(keyed, ["_k"], "id", ranked, "_before", chunk)
    return linked.withColumn("supersedes", F.col("_before.hash")).drop("_before", "_k")


def short_keys(versions: DataFrame) -> DataFrame:
    """``short``: 12 hex digits, four more at a time while an EARLIER hash shares the prefix.

    Only hashes that meet at 12 digits, which are very few, are expanded into
    their longer prefixes.
    """
    first = F.substring("hash", 1, 12)
    owners = versions.groupBy(first.alias("_p")).agg(F.min("id").alias("_owner"), F.count(F.lit(1)).alias("_n"))
    marked = versions.withColumn("_p", first).join(owners, "_p")
    unique = marked.where(F.col("id") == F.col("_owner")).withColumn("short", F.col("_p"))
    clashing = marked.where("_n > 1").select("id", "hash")
    tried = clashing.select(
        "id", "hash", F.explode(F.transform(F.sequence(F.lit(16), F.lit(64), F.lit(4)), lambda n: F.substring("hash", 1, n))).alias("_q")
    )
    owned = tried.groupBy("_q").agg(F.min("id").alias("_first"))
    longer = tried.join(owned, "_q").where(F.col("id") == F.col("_first")).groupBy("id").agg(
        F.min_by("_q", F.length("_q")).alias("_short")
    )
    rest = marked.where(F.col("id") != F.col("_owner")).join(longer, "id", "left")
    rest = rest.withColumn("short", F.coalesce("_short", "hash")).drop("_short")
    cols = [*versions.columns, "short"]
    return unique.select(*cols).unionByName(rest.select(*cols))


def write_outcomes(writes: DataFrame, chunk: int = ID_CHUNK) -> DataFrame:
    """What replace-if-larger does with each write of a folder, in order.

    The held copy is the first one of the largest size so far: a smaller copy
    is refused, and one of equal size but other bytes is refused and named.
    """
    held = F.struct(F.col("size_bytes"), (-F.col("id")).alias("first"), F.col("hash"))
    seen = running_max(writes, ["folder"], "id", held, "_held", chunk)
    outcome = (
        F.when(F.col("_held").isNull(), "written")
        .when(F.col("size_bytes") > F.col("_held.size_bytes"), "replaced")
        .when(F.col("size_bytes") < F.col("_held.size_bytes"), "refused_smaller")
        .when(F.col("hash") == F.col("_held.hash"), "unchanged")
        .otherwise("refused_different")
    )
    return seen.withColumn("outcome", outcome).drop("_held")


def event_actions(events: DataFrame, window_seconds: int = DUPLICATE_WINDOW_SECONDS, chunk: int = ID_CHUNK) -> DataFrame:
    """Action of each capture event of a hash: stored, duplicate-invocation or skipped_unchanged.

    The comparison is with the LATEST event of the hash, so a run of close
    events keeps suppressing itself.
    """
    seen = previous_row(events, ["hash"], "id", ["at"], chunk)
    gap = F.unix_micros("at") - F.unix_micros("prev_at")
    action = (
        F.when(~F.col("prev_exists"), "stored")
        .when(gap <= window_seconds * 1_000_000, "duplicate-invocation")
        .otherwise("skipped_unchanged")
    )
    return seen.withColumn("action", action).drop("prev_at", "prev_exists")


# ---- project registry -------------------------------------------------------


def resolution_key(captures: DataFrame) -> DataFrame:
    """Which evidence names the project: payload cwd, transcript cwd, folder name, or none.

    Adds ``resolution_source, session_cwd, kind, claim``.
    """
    clean = lambda c: F.when(F.trim(c) != "", F.col(c))
    payload, inner, folder = clean("payload_cwd"), clean("jsonl_cwd"), clean("encoded_dir")
    source = (
        F.when(payload.isNotNull(), "payload_cwd")
        .when(inner.isNotNull(), "jsonl_cwd")
        .when(folder.isNotNull(), "transcript_dir")
        .otherwise("unresolved")
    )
    cwd = F.coalesce(payload, inner)
    return captures.withColumns(
        {
            "resolution_source": source,
            "session_cwd": cwd,
            "kind": F.when(cwd.isNotNull(), "cwd").otherwise("encoded_dir"),
            "claim": F.coalesce(cwd, folder, F.lit("_unresolved")),
        }
    )


def resolve_projects(captures: DataFrame, alias: DataFrame, project: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project of every capture, and the projects that had to be created.

    Captures are taken in ``id`` order: the first capture that meets an unknown
    path creates its project, and a capture with only a folder name belongs to
    whichever project claimed that folder name first.
    """
    keyed = resolution_key(captures)
    known = alias.select(F.col("path").alias("claim"), "kind", F.col("project_id").alias("_known"))
    # A cwd capture also claims its folder name, unless an alias already does.
    claims = keyed.select("id", "kind", "claim", F.col("claim").alias("claim_key"), F.col("kind").alias("claim_kind"))
    folder_claims = keyed.where("kind = 'cwd' and trim(encoded_dir) <> ''").select(
        "id", F.lit("encoded_dir").alias("kind"), F.col("encoded_dir").alias("claim"),
        F.col("claim").alias("claim_key"), F.col("kind").alias("claim_kind"),
    )
    first = (
        claims.unionByName(folder_claims)
        .join(known, ["claim", "kind"], "left_anti")
        .groupBy("kind", "claim")
        .agg(F.min_by(F.struct("claim_kind", "claim_key"), F.struct("id", "claim_kind")).alias("_own"), F.min("id").alias("first_id"))
    )
    own = first.select(
        "kind", "claim", "first_id",
        F.col("_own.claim_kind").alias("own_kind"), F.col("_own.claim_key").alias("own_claim"),
    )
    # A path kept by its own first claimant makes a new project; any other path joins its owner.
    is_self = (F.col("own_kind") == F.col("kind")) & (F.col("own_claim") == F.col("claim"))
    label_path = F.when(F.col("kind") == "cwd", F.col("claim")).otherwise(F.translate("claim", "-", "/"))
    numbered = position(own.where(is_self), ["first_id", "claim"], "_at")
    highest = project.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    created = numbered.select(
        (highest + F.col("_at") + 1).alias("id"),
        paths.project_label(label_path).alias("label"),
        "kind",
        "claim",
    )
    # Folder names may belong to a project an alias already knows through the claimant's cwd.
    owner = own.select("kind", "claim", F.col("own_kind"), F.col("own_claim"))
    new_ids = created.select(F.col("kind").alias("own_kind"), F.col("claim").alias("own_claim"), F.col("id").alias("_new"))
    old_ids = known.select(F.col("kind").alias("own_kind"), F.col("claim").alias("own_claim"), F.col("_known").alias("_via"))
    routed = owner.join(new_ids, ["own_kind", "own_claim"], "left").join(old_ids, ["own_kind", "own_claim"], "left")
    routed = routed.select("kind", "claim", F.coalesce("_via", "_new").alias("_routed"))
    out = keyed.join(known, ["claim", "kind"], "left").join(routed, ["claim", "kind"], "left")
    out = out.withColumn("project_id", F.coalesce("_known", "_routed")).drop("_known", "_routed")
    return out, created


def cwds_for_directory(alias: DataFrame) -> DataFrame:
    """Every cwd of the project that owns each encoded folder name."""
    folders = alias.where("kind = 'encoded_dir'").select("project_id", F.col("path").alias("encoded_dir"))
    cwds = alias.where("kind = 'cwd'").select("project_id", F.col("path").alias("cwd"))
    return folders.join(cwds, "project_id").select("encoded_dir", "cwd")


def rename_project(project: DataFrame, project_id: int, label: str) -> DataFrame:
    return project.withColumn("label", F.when(F.col("id") == project_id, F.lit(label)).otherwise(F.col("label")))


def merge_projects(
    project: DataFrame, alias: DataFrame, versions: DataFrame, keep_id: int, merge_id: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repoint one project's versions and claims to another and retire it."""
    if keep_id == merge_id:
        raise ValueError(f"cannot merge project {keep_id} into itself")
    found = {r.id: r.retired for r in project.where(F.col("id").isin(keep_id, merge_id)).select("id", "retired").collect()}
    for wanted in (keep_id, merge_id):
        if wanted not in found:
            raise ValueError(f"project {wanted} does not exist")
    if found[keep_id]:
        raise ValueError(f"project {keep_id} is retired")
    moved = lambda df: df.withColumn(
        "project_id", F.when(F.col("project_id") == merge_id, F.lit(keep_id)).otherwise(F.col("project_id"))
    )
    retired = project.withColumn("retired", F.when(F.col("id") == merge_id, F.lit(1)).otherwise(F.col("retired")))
    return retired, moved(alias), moved(versions)


def move_project(alias: DataFrame, project_id: int, old_path: str, new_path: str, now: str) -> DataFrame:
    """Add the new path (and its folder name) as claims; refuse one that another project holds."""
    encoded = alias.sparkSession.range(1).select(paths.encode_directory(F.lit(new_path))).first()[0]
    wanted = [(old_path, "cwd"), (new_path, "cwd"), (encoded, "encoded_dir")]
    match = F.lit(False)
    for path, kind in wanted:
        match = match | ((F.col("path") == path) & (F.col("kind") == kind))
    owners = {(r.path, r.kind): r.project_id for r in alias.where(match).select("path", "kind", "project_id").collect()}
    if owners.get((old_path, "cwd")) != project_id:
        raise ValueError(f"{old_path!r} is not a cwd claim of project {project_id}")
    for claim in wanted[1:]:
        if owners.get(claim, project_id) != project_id:
            raise ValueError(f"{claim[0]!r} is already a claim of project {owners[claim]}")
    touched = alias.withColumn("last_seen", F.when(match, F.lit(now)).otherwise(F.col("last_seen")))
    missing = [(project_id, p, k, now, now) for p, k in wanted[1:] if (p, k) not in owners]
    if not missing:
        return touched
    cols = "project_id bigint, path string, kind string, first_seen string, last_seen string"
    return touched.unionByName(alias.sparkSession.createDataFrame(missing, cols), allowMissingColumns=True)


def project_summary(project: DataFrame, versions: DataFrame, alias: DataFrame) -> DataFrame:
    """Sessions and claimed paths per project."""
    counted = versions.groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions"))
    claimed = alias.groupBy("project_id").agg(F.count(F.lit(1)).alias("aliases"), F.min("path").alias("first_path"))
    base = project.select(F.col("id").alias("project_id"), "label", "retired")
    zero = F.lit(0).cast("bigint")
    return base.join(counted, "project_id", "left").join(claimed, "project_id", "left").withColumns(
        {"sessions": F.coalesce("sessions", zero), "aliases": F.coalesce("aliases", zero)}
    )


# ---- sub-agents, labels, currency -------------------------------------------

ORPHAN_LABEL = "_orphaned-subagents"


def classify_payloads(entries: DataFrame) -> DataFrame:
    """Kind of every payload from its entries: session, subagent or not-a-session.

    A sub-agent carries its parent's session id, so the test is that EVERY
    conversational entry names an agent.
    """
    talk = F.col("etype").isin("user", "assistant")
    per = entries.groupBy("path").agg(
        F.count(F.when(talk, 1)).alias("talk"),
        F.count(F.when(talk & F.col("agent_id").isNotNull(), 1)).alias("agent_talk"),
    )
    kind = (
        F.when(F.col("talk") == 0, "not-a-session")
        .when(F.col("agent_talk") == F.col("talk"), "subagent")
        .otherwise("session")
    )
    return per.withColumn("kind", kind)


def attach_subagents(subagents: DataFrame, head: DataFrame) -> DataFrame:
    """Label of each sub-agent's parent session; without one it goes to the orphan bucket."""
    parents = head.select(F.col("session_uuid").alias("parent_session_uuid"), F.col("label").alias("_label"))
    joined = subagents.join(parents, "parent_session_uuid", "left")
    return joined.withColumn("label", F.coalesce("_label", F.lit(ORPHAN_LABEL))).drop("_label")


def directory_labels(observed: DataFrame, by_folder: DataFrame) -> DataFrame:
    """Label of each directory: most of its own transcripts, else most rows under its encoded name.

    ``observed`` and ``by_folder`` are ``directory, label`` rows; ties go to the smaller label.
    """
    def most(df: DataFrame, out: str) -> DataFrame:
        counted = df.groupBy("directory", "label").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy("directory").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias(out))

    both = most(observed, "_own").join(most(by_folder, "_far"), "directory", "full_outer")
    return both.select("directory", F.coalesce("_own", "_far").alias("label"))


def import_outcomes(foreign: DataFrame, versions: DataFrame) -> DataFrame:
    """What importing each foreign payload does: store, skip a known hash, or refuse a non-session."""
    known = versions.select("hash", F.lit(True).alias("_known")).distinct()
    return foreign.join(known, "hash", "left").withColumn(
        "outcome",
        F.when(F.col("kind") == "not-a-session", "not_a_session")
        .when(F.col("_known"), "already_stored")
        .otherwise("stored"),
    ).drop("_known")


def import_report(walked: DataFrame) -> DataFrame:
    """What a walk hands to the import, and by name what it does not: ``outcome, path, size_bytes, detail``.

    Branches that were skipped or could not be read are rows of their own, so an
    import that lost a folder can never look complete.
    """
    outcome = F.when(F.col("kind") == "file", "read").otherwise(F.col("kind"))
    return walked.select(outcome.alias("outcome"), "path", "size_bytes", "detail")


def stale_folders(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """Folders whose (hash, config, renderer, child records) fingerprint is not on record: the work left to do."""
    keys = ["folder", "source_hash", "config_hash", "renderer_version", "children_hash"]
    return wanted.join(current.select(*keys), keys, "left_anti")


def short_payload_heads(versions: DataFrame, listing: DataFrame) -> DataFrame:
    """Multi-version heads stored shorter than the source file that carries the head's own hash."""
    head = multi_version_heads(versions).select("session_uuid", "hash", F.col("size_bytes").alias("stored_bytes"))
    return head.join(listing.select("hash", "path", F.col("size_bytes").alias("source_bytes")), "hash").where(
        "stored_bytes < source_bytes"
    )


def hidden_changes(versions: DataFrame, rederived: DataFrame) -> DataFrame:
    """Stored ``hidden`` flags against the current rule: flipped, unchanged or missing."""
    fresh = rederived.select("hash", F.col("hidden").alias("_now"))
    joined = versions.select("id", "hash", "hidden").join(fresh, "hash", "left")
    return joined.withColumn(
        "verdict",
        F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("hidden"), "flipped").otherwise("unchanged"),
    ).drop("_now")


def rebuild_catalogue(folded: DataFrame, payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue rows from payloads alone, oldest first, and the payloads that could not be read.

    ``folded`` is the parse fold per ``path``; ``payload`` is ``path, hash, size_bytes, captured_at``.
    """
    joined = payload.join(folded, "path", "left")
    unreadable = joined.where("line_count is null or line_count = skipped_lines").select("path", "hash")
    good = joined.where("line_count > skipped_lines")
    once = top_per_key(good, ["hash"], [F.coalesce("last_ts", "captured_at"), F.col("path")])
    ordered = position(once.withColumn("_when", F.coalesce("last_ts", "captured_at")), ["_when", "path"], "_at")
    rows = ordered.withColumn("id", F.col("_at") + 1).drop("_when", "_at")
    return short_keys(supersedes(rows)), unreadable
