"""Readers and writers of the tables that transcription runs leave."""
