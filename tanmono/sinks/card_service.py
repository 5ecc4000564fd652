"""A client for a flash-card service behind one method, and the calls that a synchronisation makes."""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable, Iterable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

from tanmono.operators import cards

Invoke = Callable[..., object]


def http_client(url: str, timeout: float = 10.0) -> Invoke:
    """invoke(action, **params) over HTTP; an error that the service reports is raised."""

    def invoke(action: str, **params: object) -> object:
        body = json.dumps({"action": action, "version": 6, "params": params}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            said = json.load(answer)
        if said.get("error"):
            raise RuntimeError(said["error"])
        return said.get("result")

    return invoke


def model_calls(name: str, fields: list[str], templates: dict[str, dict[str, str]], css: str, present: list[str] | None) -> list[tuple[str, dict]]:
    """The calls that turn a note type with the present fields, None if it does not exist, into the wanted one."""
    if present is None:
        cards = [{"Name": card, **sides} for card, sides in templates.items()]
        return [("createModel", {"modelName": name, "inOrderFields": fields, "css": css, "cardTemplates": cards})]
    added = [("modelFieldAdd", {"modelName": name, "fieldName": f, "index": n}) for n, f in enumerate(fields) if f not in present]
    looks = {"updateModelTemplates": {"templates": templates}, "updateModelStyling": {"css": css}}
    return added + [(action, {"model": {"name": name, **look}}) for action, look in looks.items()]


def ensure_model(invoke: Invoke, name: str, fields: list[str], templates: dict[str, dict[str, str]], css: str) -> None:
    """Bring a note type to the wanted fields, templates and style."""
    present = invoke("modelFieldNames", modelName=name) if name in invoke("modelNames") else None
    for action, params in model_calls(name, fields, templates, css, present):
        invoke(action, **params)


def store_media(invoke: Invoke, path: Path) -> str:
    """Upload a file; the name that the service keeps it under."""
    return str(invoke("storeMediaFile", filename=path.name, data=base64.b64encode(path.read_bytes()).decode("ascii")))


def pulled_reviews(invoke: Invoke, card_ids: Iterable[int]) -> list[tuple[int, int]]:
    """(card id, number of reviews) of the cards that the service knows."""
    return [(int(c["cardId"]), int(c["reps"])) for c in invoke("cardsInfo", cards=list(card_ids)) if c]


def push(invoke: Invoke, deck: str, model: str, rows: Iterable[dict], records: list[tuple[int, int]] | None = None) -> dict[str, int]:
    """Carry out action rows: add new notes, move and refresh existing ones; counts by action. records gets (note, card) of each row."""
    done = {"add": 0, "move": 0}
    invoke("createDeck", deck=deck)
    for row in rows:
        if row["action"] == "add":
            note = invoke("addNote", note={"deckName": deck, "modelName": model, "fields": row["fields"], "tags": row.get("tags", [])})
            made = invoke("findCards", query=f"nid:{note}") if records is not None else None
            place = (note, made[0] if made else None)
        else:
            invoke("changeDeck", cards=[row["card_id"]], deck=deck)
            invoke("updateNoteFields", note={"id": row["note_id"], "fields": row["fields"]})
            place = (row["note_id"], row["card_id"])
        done[row["action"]] += 1
        if records is not None:
            records.append(place)
    return done


def synchronise(invoke: Invoke, state: DataFrame, plan: Callable[[DataFrame], DataFrame], fields: Callable[[dict], dict], deck: str, model: str, now: datetime) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Pull reviews, plan with what they taught, add and move the planned notes, and record them: (state, learned lexemes, counts).

    state(lexeme_id, note_id, card_id, source_id, sentence_id, synced_at, reps) holds the cards; plan gets the learned(lexeme_id) and gives
    (lexeme_id, source_id, sentence_id, ...) in order, a batch of bounded size; fields makes a note of one of its rows, uploading media as
    it goes. A card without reviews moves, a lexeme without a card gets one, and cards with reviews are left alone.
    """
    spark, ids = state.sparkSession, [r.card_id for r in state.filter("card_id IS NOT NULL").select("card_id").toLocalIterator()]
    pulled = spark.createDataFrame(pulled_reviews(invoke, ids), "card_id long, reps long")
    reviewed = cards.learned(state, pulled)
    taught = reviewed.filter("learned").select("lexeme_id")
    state = state.drop("reps").join(reviewed.select("lexeme_id", "reps"), "lexeme_id", "left").select(state.columns)
    batch = plan(taught)
    wanted = cards.actions(batch, state).select("lexeme_id", "action").join(state.select("lexeme_id", "note_id", "card_id"), "lexeme_id", "left")
    rows, records, done = [r.asDict() for r in batch.join(wanted, "lexeme_id").collect()], [], {"add": 0, "move": 0}
    for row in rows:
        made = push(invoke, deck, model, [row | {"fields": fields(row)}], records)
        done = {k: done[k] + made[k] for k in done}
    fresh = [(row["lexeme_id"], note, card, row["source_id"], row["sentence_id"], now) for row, (note, card) in zip(rows, records, strict=True)]
    schema = "lexeme_id long, note_id long, card_id long, source_id long, sentence_id long, synced_at timestamp"
    return cards.recorded(state, spark.createDataFrame(fresh, schema)), taught, done | {"learned": taught.count(), "batch": len(rows)}
