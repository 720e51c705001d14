"""Vocabulary, row schemas and key templates of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY_KINDS = ("repository", "directory", "file", "module", "type", "interface", "enumeration", "function", "variable", "buildTarget", "person")
DEFINITION_KINDS = ("type", "interface", "enumeration", "function", "variable")
EDGE_KINDS = ("containsPhysical", "declares", "imports", "dependsOn", "references", "refersToSymbol", "inherits", "conformsTo", "builds", "invokes", "authoredBy", "ownedBy")
DEPENDENCY_KINDS = ("imports", "references", "refersToSymbol", "dependsOn")
LAYERS = ("observed", "derived", "inferred")
EVIDENCE = ("compiler", "syntactic", "lexical", "semantic")
#: The layer that each kind of edge belongs to.
LAYER_OF = {k: "observed" for k in ("containsPhysical", "declares", "imports", "builds", "invokes")} | {k: "derived" for k in ("dependsOn", "references", "refersToSymbol", "authoredBy")} | {"ownedBy": "inferred"}

ANCHOR = "struct<path:string,blob:string,range:struct<start_line:int,start_column:int,end_line:int,end_column:int>>"
ENTITY = "id long, stable_key string, kind string, repository_id string, first_seen long"
ENTITY_VERSION = f"id long, entity_id long, valid_from long, valid_to long, name string, properties map<string,string>, anchors array<{ANCHOR}>"
RELATIONSHIP = "id long, kind string, source_id long, target_id long, layer string, valid_from long, valid_to long, properties map<string,string>"
OBSERVATION = "id long, kind string, snapshot_id string, path string, blob_hash string, start_line int, end_line int, payload map<string,string>, extractor string, extractor_version string"
SNAPSHOT_FILE = "snapshot_id string, path string, blob_hash string, size long, lang string"


def repo_key(repo: Column) -> Column:
    return F.concat(F.lit("phys:repo:"), repo)


def dir_key(repo: Column, path: Column) -> Column:
    return F.concat(F.lit("phys:dir:"), repo, F.lit("/"), path)


def file_key(repo: Column, path: Column) -> Column:
    return F.concat(F.lit("phys:file:"), repo, F.lit("/"), path)


def decl_key(lang: Column, repo: Column, path: Column, decl_path: Column) -> Column:
    return F.concat(lang, F.lit(":decl:"), repo, F.lit("/"), path, F.lit("#"), decl_path)


def module_key(lang: Column, name: Column) -> Column:
    return F.concat(lang, F.lit(":module:"), name)


def person_key(identity: Column) -> Column:
    return F.concat(F.lit("person:"), identity)


def target_key(repo: Column, path: Column, name: Column) -> Column:
    return F.concat(F.lit("build:target:"), repo, F.lit("/"), path, F.lit("#"), name)


def path_of_key(key: Column, repo: str) -> Column:
    """The path of a file's stable key within a repository."""
    return F.when(key.startswith(f"phys:file:{repo}/"), F.substring(key, len(f"phys:file:{repo}/") + 1, 1 << 30))


def identity(email: Column, name: Column) -> Column:
    """A person's identity: the lower-cased email, or the name where there is none."""
    return F.coalesce(F.nullif(F.lower(F.trim(email)), F.lit("")), F.trim(name))


def canonical_json(properties: Column) -> Column:
    """A property map as JSON with sorted keys: equal bags give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties))))
