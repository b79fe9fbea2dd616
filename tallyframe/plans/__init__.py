"""What a comparison returns, and views of it."""
