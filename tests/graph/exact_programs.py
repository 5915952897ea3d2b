"""A longer program in each language, with exactly the definitions and calls that must be found in it."""

EXACT = {
    "rust": (
        '''#[cfg(all(test, unix))]
pub(crate) struct Pair(u32, u32);

pub(super) enum Shape {
    Dot,
    Line(u32, Point),
}

pub(crate) fn area<F: Fn(u32) -> u32>(s: &Shape, f: F) -> u32 {
    let Some(n) = find(s) else { return zero() };
    match s {
        Shape::Line(a, Point { x }) if check(*a) => grow(*a).scale(2).round(),
        Shape::Dot | Shape::Line(_, _) => f(n),
    }
}

fn main() {
    let v = Vec::<u32>::with_capacity(4);
    v.iter().map(|x| twice(x)).collect::<Vec<_>>();
    assert_eq!(hidden(1), 2);
    *v.get_mut(0) = if let Ok(x) = parse("fake(1)") { x } else { 0 };
}
''',
        {("Pair", "struct"), ("Shape", "enum"), ("area", "fn"), ("main", "fn")},
        {("area", "find", "direct"), ("area", "zero", "direct"), ("area", "check", "direct"), ("area", "grow", "direct"), ("area", "scale", "method"), ("area", "round", "method"), ("area", "f", "direct"),
         ("main", "Vec::with_capacity", "associated"), ("main", "iter", "method"), ("main", "map", "method"), ("main", "twice", "direct"), ("main", "collect", "method"), ("main", "assert_eq", "macro"), ("main", "get_mut", "method"), ("main", "parse", "direct")},
    ),
    "go": (
        '''package main

import (
	"fmt"
	"os"
)

var (
	limit = pick(3)
)

type Reader interface {
	Read(p []byte) (int, error)
	Close() error
}

type box struct{ run func(int) int }

func (b *box) Open(r Reader) (int, error) {
	defer b.unlock()
	go func() { work(1) }()
	x := []byte(b.name())
	switch y := r.(type) {
	case nil:
		return len(x), fmt.Errorf("bad %v", y)
	}
	return b.load(os.Args[1]).size(), nil
}
''',
        {("Reader", "interface"), ("box", "struct"), ("Open", "method")},
        {("", "pick", "direct"), ("Open", "unlock", "method"), ("Open", "work", "direct"), ("Open", "name", "method"), ("Open", "len", "direct"), ("Open", "fmt.Errorf", "constructor"), ("Open", "load", "method"), ("Open", "size", "method")},
    ),
    "c": (
        '''#include <stdio.h>
#define MAX(a, b) pick(a, b)
#if defined(X) && \\
    defined(Y)
#endif

static int helper(int x);
char *name_of(struct node *n);

static struct node *
make_node(int value,
          int other)
{
    struct node *n = alloc(sizeof(struct node));
    if (n == NULL)
        return fail("no memory()");
    select(n, when(value));
    return n;
}

int main(void)
{
    for (int i = 0; i < count(); i++)
        lock(make_node(i, 2));
    return match(3);
}
''',
        {("make_node", "fn"), ("main", "fn")},
        {("make_node", "alloc", "direct"), ("make_node", "fail", "direct"), ("make_node", "select", "direct"), ("make_node", "when", "direct"), ("main", "count", "direct"), ("main", "lock", "direct"), ("main", "make_node", "direct"), ("main", "match", "direct")},
    ),
    "cpp": (
        '''#include "a.h"
namespace shop {
class Cart {
 public:
  Cart(int n);
  int total() const { return sum(items_) + tax(); }
};

int Cart::count(int n) const {
  Widget w(n);
  auto p = new Gadget(make(1));
  return w.size() + store::load(n) + largest<int>(n, 2);
}
}
''',
        {("shop", "namespace"), ("Cart", "class"), ("total", "fn"), ("Cart::count", "fn")},
        {("total", "sum", "direct"), ("total", "tax", "direct"), ("Cart::count", "make", "direct"), ("Cart::count", "size", "method"), ("Cart::count", "load", "method"), ("Cart::count", "largest", "direct")},
    ),
    "javascript": (
        '''const fs = require("fs");

const load = async (path) => {
  const data = await read(path);
  return data.lines().map(async (x) => clean(x)).filter(match);
};

export default class Shop extends Base {
  constructor(a) {
    super(a);
    this.items = new Map(entries(a));
  }
  sell(item) {
    if (when(item)) { return this.stock.select(item); }
    return import("x");
  }
}

async function run() {
  for (const x of list()) { await (go(x)); }
}
''',
        {("load", "arrow"), ("Shop", "class"), ("constructor", "method"), ("sell", "method"), ("run", "function")},
        {("load", "read", "direct"), ("load", "lines", "method"), ("load", "map", "method"), ("load", "clean", "direct"), ("load", "filter", "method"), ("constructor", "entries", "direct"), ("sell", "when", "direct"), ("sell", "select", "method"), ("run", "list", "direct"), ("run", "go", "direct")},
    ),
    "typescript": (
        '''import { Base } from "./base";

interface Store<T> extends Base {
  get(id: string): T;
  all(): T[];
}

type Id = string;

abstract class Shop {
  abstract price(x: number): number;
  sell(id: Id): number {
    return this.store.get(id).cost() + fee<number>(2);
  }
}

const pick = async (x: Id): Promise<number> => lookup(x);
''',
        {("Store", "interface"), ("Id", "type"), ("Shop", "class"), ("sell", "method"), ("pick", "arrow")},
        {("sell", "get", "method"), ("sell", "cost", "method"), ("sell", "fee", "direct"), ("pick", "lookup", "direct")},
    ),
    "java": (
        '''package a;
import java.util.List;

@Service("x")
public class Shop extends Base implements Seller {
    private int limit = start(1);

    public int sell(@Named("y") String item) throws Exception {
        when(item).thenReturn(match(2));
        synchronized (this) { lock(); }
        List<String> out = new ArrayList<>(size());
        new a.Made(out).start();
        return select(this.stock.find(item).get());
    }

    interface Seller { int price(int x); }
}
''',
        {("Shop", "class"), ("limit", "field"), ("sell", "method"), ("Seller", "interface"), ("price", "method")},
        {("", "start", "direct"), ("sell", "when", "direct"), ("sell", "thenReturn", "method"), ("sell", "match", "direct"), ("sell", "lock", "direct"), ("sell", "size", "direct"), ("sell", "start", "method"), ("sell", "select", "direct"), ("sell", "find", "method"), ("sell", "get", "method")},
    ),
    "ruby": (
        '''require "set"

class Shop < Base
  attr_reader :items

  def sell(item)
    item.run_it
    stock.find(item).first.price
    raise Error, "no" if item.nil?
    total = items.map { |x| x.cost }.sum
    puts total
    notify item, total
    @log.write(total) unless quiet?(item)
    1..total
  end

  def self.open(path)
    new(path).fetch
  end
end
''',
        {("Shop", "class"), ("sell", "method"), ("open", "class_method")},
        {("", "attr_reader", "direct"), ("sell", "run_it", "method"), ("sell", "find", "method"), ("sell", "first", "method"), ("sell", "price", "method"), ("sell", "raise", "direct"), ("sell", "nil?", "method"), ("sell", "map", "method"), ("sell", "cost", "method"), ("sell", "sum", "method"), ("sell", "notify", "direct"), ("sell", "write", "method"), ("sell", "quiet?", "direct"), ("open", "new", "direct"), ("open", "fetch", "method")},
    ),
    "lua": (
        '''local log = require("log")
local M = {}

function M.open(path)
  local f = find(path)
  print("x")
  return f:read(2), M.close(f)
end

function M:close()
  self.handle:shut()
end

local function start() return M.open("a") end
''',
        {("M.open", "function"), ("close", "method"), ("start", "local_function")},
        {("M.open", "find", "direct"), ("M.open", "read", "method"), ("M.open", "close", "method"), ("close", "shut", "method"), ("start", "open", "method")},
    ),
    "swift": (
        '''import Foundation

class Shop: Base {
    let limit: Int = start()
    @objc(sellIt) func sell(_ item: Item) -> Int {
        guard let x = find(item) else { return zero() }
        return stock.pick(x).cost()
    }
}
''',
        {("Shop", "class"), ("limit", "property"), ("sell", "func")},
        {("", "start", "direct"), ("sell", "find", "direct"), ("sell", "zero", "direct"), ("sell", "pick", "method"), ("sell", "cost", "method")},
    ),
    "haskell": (
        '''module Shop where
import Data.List (sort)

data Item = Item Int
  deriving (Show, Eq)

newtype Box = Box Int deriving (Show)

sell :: Item -> Int
sell x = price (find x)
''',
        {("Item", "data"), ("Box", "data"), ("sell", "signature"), ("sell", "function")},
        {("sell", "price", "direct"), ("sell", "find", "direct")},
    ),
    "csharp": (
        '''using System;

public class Shop : Base {
    [Route("x")]
    public int Sell(Item item) {
        if (item is null) throw new Failure(Why(item));
        Widget w = Make(1);
        return stock.Find(item).Cost();
    }
}
''',
        {("Shop", "class"), ("Sell", "method")},
        {("Sell", "Why", "method"), ("Sell", "Make", "method"), ("Sell", "Find", "method"), ("Sell", "Cost", "method")},
    ),
    "scala": (
        '''import a.b

case class Item(name: String)

object Shop extends Base {
  @tailrec
  def sell(item: Item): Int = {
    val x = find(item).get()
    if (ready(x)) cost[Int](x) else zero()
  }
}
''',
        {("Item", "class"), ("Shop", "object"), ("sell", "function")},
        {("sell", "find", "method"), ("sell", "get", "method"), ("sell", "ready", "method"), ("sell", "cost", "method"), ("sell", "zero", "method")},
    ),
    "python": (
        '''import os, sys
from a import b

@wraps(thing)
def sell(item, *, limit=start(1)):
    with lock() as x:
        return [pick(i).cost() for i in stock.find(item)] + Shop.Item(2)

class Shop:
    async def load(self):
        await self.read()
''',
        {("sell", "def"), ("Shop", "class"), ("load", "def")},
        {("sell", "wraps", "direct"), ("sell", "start", "direct"), ("sell", "lock", "direct"), ("sell", "pick", "direct"), ("sell", "cost", "method"), ("sell", "find", "method"), ("sell", "Shop.Item", "constructor"), ("load", "read", "method")},
    ),
}
