"""Landed files in, snapshots out."""
