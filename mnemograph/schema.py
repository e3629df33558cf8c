"""Schemas of the graph-memory tables."""

from __future__ import annotations

MICRO = "event_id string, event_type string, time_range array<string>, subject string, object string, action string, description string, macro_id string"
ENTITY = "entity_id string, name string, entity_type string, attributes map<string,string>, description string, macro_id string"
EDGE = "source_id string, target_id string, relation_label string, relation_type string, description string"
SCREEN = "text_id string, text string, time_range array<string>, description string, macro_id string"


def nested(fields: str) -> str:
    """A field list as a struct type."""
    parts, start, depth = [], 0, 0
    for i, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = fields[start:i].strip().partition(" ")
            parts.append(f"{name}:{kind}")
            start = i + 1
    return f"struct<{','.join(parts)}>"


SUBGRAPH = f"macro_id string, micro_events array<{nested(MICRO)}>, entities array<{nested(ENTITY)}>, edges array<{nested(EDGE)}>, on_screen_texts array<{nested(SCREEN)}>"
MACRO = f"macro_id string, label string, time_range array<string>, summary string, key_entities array<struct<name:string,type:string>>, event_types array<string>, ocr_texts array<string>, dense_description string, asr_text string, subgraph {nested(SUBGRAPH)}, super_id string"
SUPER = "super_id string, label string, description string, sub_macro_ids array<string>, time_range array<string>, key_entities array<string>"
ROOT = "title string, description string, themes array<string>, key_entities array<string>, emotional_tone string"
RELATION = "source string, target string, type string, reason string"
MEMORY = f"video_key string, video_path string, root {nested(ROOT)}, super_events array<{nested(SUPER)}>, macro_events array<{nested(MACRO)}>, macro_relations array<{nested(RELATION)}>, super_relations array<{nested(RELATION)}>"
NODE = "node_id string, node_type string, text string, macro_id string"

#: The older layout: names in parallel lists, whole subgraphs nowhere. An entity is a text or an object, read as text.
LEGACY_SUPER = "node_id string, label string, description string, sub_macro_ids array<string>, time_range array<string>, key_entities array<string>"
LEGACY_MACRO = "node_id string, label string, time_range array<string>, summary string, key_entities array<string>, event_types array<string>, ocr_texts array<string>, dense_description string, asr_text string, subevent_ids array<string>, event_summaries array<string>, key_entity_names array<string>, key_entity_types array<string>"
LEGACY_RELATION = "source_id string, source string, target_id string, target string, relation_type string, type string, reason string"
LEGACY = f"graph_id string, root_event {nested(ROOT)}, super_events array<{nested(LEGACY_SUPER)}>, macro_events array<{nested(LEGACY_MACRO)}>, macro_relations array<{nested(LEGACY_RELATION)}>, super_relations array<{nested(LEGACY_RELATION)}>"
