"""Streaming: the query language has no subscriptions, so nothing is offered here; `events` is a batch table like the others."""
