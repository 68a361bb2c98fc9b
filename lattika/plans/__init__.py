"""Queries over the test tables, with SQL for each where SQL has it."""
