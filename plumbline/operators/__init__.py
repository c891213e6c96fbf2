"""Rules and analyses over the frames of tiles and styles."""
