"""Raw landed records -> posting rows."""
