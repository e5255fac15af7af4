"""Reading and storing artifacts and labelled tables."""
