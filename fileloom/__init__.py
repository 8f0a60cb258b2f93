"""File conversion as DataFrame queries."""
