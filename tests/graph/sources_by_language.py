"""A small program in each language, and what must be found in it: (kinds by name, imports, calls, types, bindings)."""

SOURCES = {
    "rust": (
        """use std::collections::HashMap;
use crate::util::{load, save};
use super::shapes::*;

/// Holds things.
#[derive(Debug)]
pub struct Store { items: Vec<Item> }

pub trait Run { fn run(&self) -> Outcome; }

impl Run for Store {
    fn run(&self) -> Outcome {
        let x = Item::new(1); // Item::fake()
        helper(x);
        println!("call(me)");
        self.items.push(x);
        Outcome::Done(1)
    }
}

enum Outcome { Done(i32), Failed }
const LIMIT: usize = 3;
fn helper<'a>(item: Item) -> Option<Thing> { None }
mod inner { pub fn deep() {} }
""",
        {"Store": {"struct", "impl_trait"}, "Run": {"trait"}, "run": {"fn"}, "Outcome": {"enum"}, "LIMIT": {"const"}, "helper": {"fn"}, "inner": {"mod"}, "deep": {"fn"}},
        {"std::collections::HashMap", "crate::util::load::save", "super::shapes::*"},
        {("run", "Item::new", "associated"), ("run", "helper", "direct"), ("run", "println", "macro"), ("run", "push", "method"), ("run", "Outcome::Done", "constructor")},
        {("run", "Outcome", "return"), ("helper", "Item", "parameter"), ("helper", "Thing", "return")},
    ),
    "python": (
        '''import os.path as p
from a.b import c, d as e
from f import *

class Base: pass

class Child(Base):
    """Says things.

    @param nothing
    """

    @property
    def size(self, other: Other) -> Result:
        helper(1)
        return self.names.sort()

def helper(x):
    return mod.Thing(x)
''',
        {"Base": {"class"}, "Child": {"class"}, "size": {"def"}, "helper": {"def"}},
        {"os.path", "a.b", "f"},
        {("size", "helper", "direct"), ("size", "sort", "method"), ("helper", "mod.Thing", "constructor")},
        {("size", "Other", "parameter"), ("size", "Result", "return")},
    ),
    "go": (
        """package main

import (
    "fmt"
    log "github.com/x/logger"
)

// Server serves.
type Server struct { name string }
type Doer interface { Do() }
type Handler func(int) error

func (s *Server) start(c Config) Result {
    s.open()
    helper()
    fmt.Println("x")
    return Result{}
}

func helper() {}
""",
        {"Server": {"struct"}, "Doer": {"interface"}, "Handler": {"func_type"}, "start": {"method"}, "helper": {"func"}},
        {"fmt", "github.com/x/logger"},
        {("start", "open", "method"), ("start", "helper", "direct"), ("start", "fmt.Println", "constructor")},
        {("start", "Config", "parameter"), ("start", "Result", "return")},
    ),
    "c": (
        """#include <stdio.h>
#include "own.h"
typedef struct node node_t;
struct node { int a; };
union both { int a; float b; };
enum color { RED };
typedef int (*callback)(int);
static int counter = 0;

/* main entry */
int run(struct node *n, widget w) {
    if (n) { helper(n); }
    return printf("no_call(1)");
}
""",
        {"node_t": {"typedef"}, "node": {"struct"}, "both": {"union"}, "color": {"enum"}, "callback": {"fn_ptr"}, "counter": {"var"}, "run": {"fn"}},
        {"stdio.h", "own.h"},
        {("run", "helper", "direct"), ("run", "printf", "direct")},
        {("run", "widget", "parameter")},
    ),
    "cpp": (
        """#include <vector>
namespace app {
class Shape { };
class Circle : public Shape, private Round {
  public:
    double area(Unit u) const { return scale(u) + helper.value(); }
};
struct Point { int x; };
template <typename T> class Box { T item; };
template <typename T, typename U> T pick(T a, U b) { return a; }
}
""",
        {"app": {"namespace"}, "Shape": {"class"}, "Circle": {"class"}, "area": {"fn"}, "Point": {"struct"}, "Box": {"template_class"}, "pick": {"template_fn"}},
        {"vector"},
        {("area", "scale", "direct"), ("area", "value", "method")},
        {("area", "Unit", "parameter")},
    ),
    "javascript": (
        """import React, { useState } from 'react';
export * from './all';
const fs = require('fs');

/** Adds. */
export function add(a, b) { return helper(a) + b; }
const twice = (x) => add(x, x);
class Dog extends Animal {
  bark(loud) { console.log('fake()'); this.run(); }
}
""",
        {"add": {"function"}, "twice": {"arrow"}, "Dog": {"class"}, "bark": {"method"}},
        {"react", "./all", "fs"},
        {("add", "helper", "direct"), ("twice", "add", "direct"), ("bark", "log", "method"), ("bark", "run", "method")},
        set(),
    ),
    "typescript": (
        """import { A } from "./a";
export interface Shape extends Base { area(): number }
type Id = string;
enum Color { Red }
export class Square implements Shape {
  private side: number;
  grow(by: Amount): Square { return make(by); }
}
function make(a: Amount): Square { return new Square(); }
""",
        {"Shape": {"interface"}, "Id": {"type"}, "Color": {"enum"}, "Square": {"class"}, "grow": {"method"}, "make": {"function"}},
        {"./a"},
        {("grow", "make", "direct")},
        {("grow", "Amount", "parameter"), ("make", "Amount", "parameter"), ("make", "Square", "return")},
    ),
    "java": (
        """package a.b;
import java.util.List;
import static org.x.Y.*;

/** A service. */
public class Service extends Base implements Runnable, Closeable {
    private final Repo repo = null;
    @Override
    public Result run(Request request) {
        helper(request);
        return repo.find(request);
    }
    private native int fast(int a);
}
interface Thing { void act(); }
enum Kind { A, B }
""",
        {"Service": {"class"}, "repo": {"field"}, "run": {"method"}, "fast": {"method"}, "Thing": {"interface"}, "act": {"method"}, "Kind": {"enum"}},
        {"java.util.List", "org.x.Y"},
        {("run", "helper", "direct"), ("run", "find", "method")},
        {("run", "Request", "parameter"), ("run", "Result", "return")},
    ),
    "ruby": (
        """require 'json'
require_relative 'own/helper'

module Tools
  # Sorts things.
  class Sorter < Base
    def self.build(x)
      make(x)
    end

    def sort(items)
      items.each do |i|
        check(i) if i
      end
    end
  end
end
""",
        {"Tools": {"module"}, "Sorter": {"class"}, "build": {"class_method"}, "sort": {"method"}},
        {"json", "own/helper"},
        {("build", "make", "direct"), ("sort", "check", "direct")},
        set(),
    ),
    "lua": (
        """local json = require("json")
-- Adds.
function M.add(a, b)
  if a then return helper(a) end
  return b
end
function M:run(x) self.store:get(x) end
local function helper(a) return a end
""",
        {"M.add": {"function"}, "run": {"method"}, "helper": {"local_function"}},
        {"json"},
        {("M.add", "helper", "direct"), ("run", "get", "method")},
        set(),
    ),
    "swift": (
        """import Foundation
protocol Shape { }
/// A circle.
class Circle: Shape {
    var radius: Double
    func area(unit: Unit) -> Size { return scale(unit) }
}
struct Point { }
enum Kind { case a }
""",
        {"Shape": {"protocol"}, "Circle": {"class"}, "radius": {"property"}, "area": {"func"}, "Point": {"struct"}, "Kind": {"enum"}},
        {"Foundation"},
        {("area", "scale", "direct")},
        {("area", "Unit", "parameter"), ("area", "Size", "return")},
    ),
    "haskell": (
        """module Main where
import qualified Data.Map as M
import Data.List (sort)

-- | A tree.
data Tree a = Leaf | Node a
type Name = String
class Shape a where
  area :: a -> Double
instance Shape Circle where
  area c = 1

total :: [Int] -> Int
total xs = summed xs
main = putStrLn "x"
""",
        {"Tree": {"data"}, "Name": {"type"}, "Shape": {"class"}, "Shape Circle": {"instance"}, "total": {"signature", "function"}, "main": {"function"}},
        {"Data.Map", "Data.List"},
        {("total", "summed", "direct")},
        set(),
    ),
    "csharp": (
        """using System.Text;
using Alias = A.B.C;
namespace App {
public class Service<T> : Base, IRun {
    private readonly Repo repo;
    public string Name { get; set; }
    public static Result Run(Request request) { repo.Find(request); return null; }
}
public interface IRun { void Go(); }
public struct Pair { }
public enum Kind { A }
public record Item(int Id);
}
""",
        {"Service": {"class"}, "repo": {"field"}, "Name": {"property"}, "Run": {"method"}, "IRun": {"interface"}, "Pair": {"struct"}, "Kind": {"enum"}, "Item": {"record"}},
        {"System.Text", "A.B.C"},
        {("Run", "Find", "method")},
        {("Run", "Request", "parameter"), ("Run", "Result", "return")},
    ),
    "scala": (
        """package a
import scala.collection.mutable
import a.b.{C, D => E}
import x.y._

/** Runs. */
case class Item[T](id: Int)
trait Shape { def area(u: Unit2): Size }
object Main extends App {
  def run(x: Request): Result = { helper(x); store.get(x) }
}
enum Color { case Red }
""",
        {"Item": {"class"}, "Shape": {"trait"}, "area": {"function"}, "Main": {"object"}, "run": {"function"}, "Color": {"enum"}},
        {"scala.collection.mutable", "a.b", "x.y"},
        {("run", "helper", "method"), ("run", "get", "method")},
        {("run", "Request", "parameter"), ("run", "Result", "return")},
    ),
}
