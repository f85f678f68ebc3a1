"""Readers that turn raw inputs (repositories, manifests, markup, history) into typed tables."""
