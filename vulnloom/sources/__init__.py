"""Tables in and reports out."""
